"""Which files are indexed: names, folders, types, sizes, and a look at the first bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions import text as T

# Folder names that are never entered, name endings and names that are never indexed, and the rest.
DENIED_FOLDERS = [
    "node_modules", ".git", ".next", "venv", ".venv", "__pycache__", ".idea", ".vscode", "build", "dist", "vendor", "coverage", ".cache", "tmp", "temp",
    "windows", "system32", "syswow64", "winsxs", "program files", "program files (x86)", "$recycle.bin", "system volume information", "recovery",
    "perflogs", "appdata", "target", ".gradle", ".m2", "out", ".dart_tool", ".pub-cache", ".pytest_cache", ".mypy_cache", ".tox", "site-packages",
    "__mocks__", "obj", "packages", "bin",
]
DENIED_ENDINGS = [".tmp", ".crdownload", ".part", ".download", ".opdownload", ".~tmp", ".bak", ".log"]
DENIED_NAMES = ["desktop.ini", "thumbs.db", "ntuser.dat"]
EXTENSIONS = [".txt", ".md", ".pdf", ".docx", ".pptx"]
LEAST_BYTES, MOST_BYTES = 50, 104_857_600
SNIFF_BYTES = 512
# The published signatures of content sniffing, as patterns of the first bytes in hexadecimal.
SIGNATURES = [
    ("255044462D", "application/pdf"),
    ("252150532D41646F62652D", "application/postscript"),
    ("FEFF....", "text/plain; charset=utf-16be"),
    ("FFFE....", "text/plain; charset=utf-16le"),
    ("EFBBBF..", "text/plain; charset=utf-8"),
    ("00000100", "image/x-icon"),
    ("00000200", "image/x-icon"),
    ("424D", "image/bmp"),
    ("474946383761", "image/gif"),
    ("474946383961", "image/gif"),
    ("52494646........574542505650", "image/webp"),
    ("89504E470D0A1A0A", "image/png"),
    ("FFD8FF", "image/jpeg"),
    ("464F524D........41494646", "audio/aiff"),
    ("494433", "audio/mpeg"),
    ("4F67675300", "application/ogg"),
    ("4D54686400000006", "audio/midi"),
    ("52494646........41564920", "video/avi"),
    ("52494646........57415645", "audio/wave"),
    ("000000..66747970(6D7034|.{16}(.{8})*6D7034)", "video/mp4"),
    ("1A45DFA3", "video/webm"),
    (".{68}4C50", "application/vnd.ms-fontobject"),
    ("00010000", "font/ttf"),
    ("4F54544F", "font/otf"),
    ("74746366", "font/collection"),
    ("774F4646", "font/woff"),
    ("774F4632", "font/woff2"),
    ("1F8B08", "application/x-gzip"),
    ("504B0304", "application/zip"),
    ("526172211A0700", "application/x-rar-compressed"),
    ("526172211A070100", "application/x-rar-compressed"),
    ("0061736D", "application/wasm"),
]
# Fixed value: tags that begin marked-up text if a blank or > follows.
TAGS = ["!doctype html", "html", "head", "script", "iframe", "h1", "div", "font", "table", "a", "style", "title", "b", "body", "br", "p", "!--"]


def visible(name: Column) -> Column:
    """Names that don't start as hidden or lock files do."""
    return ~F.lower(name).rlike(r"^(\.|~\$)")


def open_folder(path: Column, root: str = "") -> Column:
    """No folder from the root's own name down is hidden or denied."""
    below = F.substring(path, len(_parent(root)) + 1, 1 << 30) if root else path
    parts = F.filter(F.split(F.lower(below), r"[/\\]"), lambda p: p != "")
    return ~F.exists(parts, lambda p: p.isin(*DENIED_FOLDERS) | p.rlike(r"^(\.|~\$)"))


def _parent(root: str) -> str:
    cut = max(root.rstrip("/\\").rfind("/"), root.rstrip("/\\").rfind("\\"))
    return root[:cut] if cut > 0 else ""


def wanted_name(name: Column) -> Column:
    low = F.lower(name)
    noise = low.isin(*DENIED_NAMES) | low.startswith(".~lock.")
    for e in DENIED_ENDINGS:
        noise = noise | low.endswith(e)
    return visible(name) & ~noise & T.extension(name).isin(*EXTENSIONS)


def wanted_size(size: Column) -> Column:
    return size.between(LEAST_BYTES, MOST_BYTES)


def target(name: Column, folder: Column, size: Column, root: str = "") -> Column:
    """The whole filter, the cheap conditions first."""
    return wanted_size(size) & wanted_name(name) & open_folder(folder, root)


def sniff(content: Column, strict_padding: bool = False) -> Column:
    """Content type by the first 512 bytes: a known signature, else plain text or octet-stream; null for empty and null content.

    strict_padding treats short contents as if NULs followed, which makes them binary.
    """
    head = F.substring(content.cast("binary"), 1, SNIFF_BYTES)
    code = F.hex(head)
    latin = F.decode(head, "ISO-8859-1")
    text = F.lower(F.regexp_replace(latin, r"^[\t\n\x0C\r ]+", ""))
    binary = latin.rlike(r"[\x00-\x08\x0B\x0E-\x1A\x1C-\x1F]")
    if strict_padding:
        binary = binary | (F.length(head) < SNIFF_BYTES)
    out = F.when(F.coalesce(F.length(head), F.lit(0)) == 0, F.lit(None).cast("string"))
    out = out.when(text.rlike(rf"^<({'|'.join(TAGS)})[ >]"), "text/html; charset=utf-8").when(text.startswith("<?xml"), "text/xml; charset=utf-8")
    # Text rarely begins like any signature: one pattern tells, and only then is it asked which.
    known = F.lit(None).cast("string")
    for pattern, kind in reversed(SIGNATURES):
        known = F.when(code.rlike(f"^{pattern}"), kind).otherwise(known)
    out = out.when(code.rlike("^(" + "|".join(p for p, _ in SIGNATURES) + ")"), known)
    return out.when(binary, "application/octet-stream").otherwise("text/plain; charset=utf-8")


def sniffed_ok(content: Column) -> Column:
    """Whether the content's type is one of those that are indexed."""
    return F.coalesce(sniff(content).isin("application/pdf", "application/zip", "text/plain; charset=utf-8"), F.lit(False))
