"""Text functions as column expressions: cleaning, repairs, tokens, paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the characters that a Unicode trim removes.
SPACE_CLASS = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: The same for Python's patterns.
SPACE_PATTERN = r"[\t\n\x0B\f\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
#: The patterns of words torn at the line ends of PDF pages.
TORN_BY_HYPHEN = r"([a-zA-Z])-\n([a-zA-Z])"
TORN_BY_LINE = r"([a-zA-Z])\n([a-zA-Z])"
#: Accented Latin letters and the letters that a case- and accent-blind comparison takes them for.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćčďēėęěğģīįķļłńņňōőŕřśšťūůűųźżž"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyaaaccdeeeeggiikllnnnoorrsstuuuuzzz"


def trim(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, f"^{SPACE_CLASS}+|{SPACE_CLASS}+$", "")


def sanitize(text: Column) -> Column:
    """No NUL, line ends as \\n, at most one empty line, single blanks, trimmed. Strings of Spark are valid UTF-8 already."""
    out = F.replace(text, F.lit("\x00"), F.lit(""))
    out = F.replace(F.replace(out, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    return trim(F.regexp_replace(out, r"[ \t]+", " "))


def plain_text(text: Column) -> Column:
    """A plain-text file as read: each line cleaned, empty ones dropped, every line ended."""
    lines = F.filter(F.transform(F.split(text, "\n"), sanitize), lambda s: F.length(s) > 0)
    return F.concat(F.array_join(lines, "\n"), F.when(F.size(lines) > 0, "\n").otherwise(""))


def repair_pdf_lines(text: Column) -> Column:
    """Words torn by hyphens or line ends put together, remaining line ends as blanks."""
    out = F.regexp_replace(F.regexp_replace(text, TORN_BY_HYPHEN, "$1$2"), TORN_BY_LINE, "$1$2")
    return F.replace(out, F.lit("\n"), F.lit(" "))


def tokens(text: Column) -> Column:
    """Words of the case- and accent-folded text."""
    folded = F.translate(F.lower(text), ACCENTED, PLAIN)
    return F.filter(F.split(folded, r"[^\p{L}\p{N}\p{Co}]+"), lambda w: w != "")


def phrase(query: Column) -> Column:
    """A search text as one quoted phrase."""
    return F.concat(F.lit('"'), F.replace(query, F.lit('"'), F.lit("")), F.lit('"'))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)[/\\]*$", 1)


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, r"[/\\]+[^/\\]*[/\\]*$", "")


def extension(path: Column) -> Column:
    """The last .ext of the name, lower-cased, or an empty string."""
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]*)$", 1))


def route(name: Column) -> Column:
    """The reader that a file's extension asks for: plain, pdf, docx or pptx, else `no extension` or `unsupported`."""
    ext = extension(name)
    return F.when(ext == "", "no extension").when(ext.isin(".txt", ".md"), "plain").when(ext.isin(".pdf", ".docx", ".pptx"), F.substring(ext, 2, 9)).otherwise("unsupported")


def under(path: Column, root: str) -> Column:
    """Whether a path is root or below it; no pattern, so % and _ in names mean themselves."""
    sep = "\\" if "\\" in root else "/"
    return (path == root) | path.startswith(root.rstrip("/\\") + sep)


def moved(path: Column, old: str, new: str) -> Column:
    """path with its prefix old replaced."""
    return F.concat(F.lit(new), F.substring(path, len(old) + 1, 1 << 30))


def clean_path(path: Column) -> Column:
    """A path in its shortest spelling: no double or trailing separators, no `.`, and `..` taken back where it can be.

    An empty path is `.`; a path keeps the separator that it uses (both are understood)."""
    back = path.contains("\\")
    drive = F.regexp_extract(path, r"^([A-Za-z]:)", 1)
    rest = F.substring(path, F.length(drive) + 1, F.length(path))
    rooted = rest.rlike(r"^[/\\]")
    parts = F.filter(F.split(rest, r"[/\\]+"), lambda p: (p != "") & (p != "."))
    none = F.array().cast("array<string>")

    def step(kept: Column, part: Column) -> Column:
        free = (F.size(kept) > 0) & (F.coalesce(F.try_element_at(kept, F.lit(-1)), F.lit("..")) != "..")
        up = F.when(free, F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).when(rooted, kept).otherwise(F.concat(kept, F.array(part)))
        return F.when(part == "..", up).otherwise(F.concat(kept, F.array(part)))

    sep = F.when(back, "\\").otherwise("/")
    body = F.array_join(F.aggregate(parts, none, step), "\x00")
    out = F.concat(F.when(rooted, sep).otherwise(""), F.replace(body, F.lit("\x00"), sep))
    return F.concat(drive, F.when(out == "", ".").otherwise(out))


def format_bytes(size: Column) -> Column:
    """A size as it is shown: `0 B`, else one digit after the point and the unit, of B to GB."""
    k = F.least(F.floor(F.log(F.greatest(size, F.lit(1)).cast("double")) / F.log(F.lit(1024.0)) + 1e-12), F.lit(3)).cast("int")
    unit = F.element_at(F.array(*map(F.lit, ["B", "KB", "MB", "GB"])), k + 1)
    shown = F.format_string("%.1f", size.cast("double") / F.pow(F.lit(1024.0), k))
    return F.when(size == 0, "0 B").when(size.isNotNull(), F.concat(shown, F.lit(" "), unit))


def format_date(seconds: Column) -> Column:
    """A time in seconds as it is shown; null and 0 as a dash."""
    return F.when(F.coalesce(seconds, F.lit(0)) == 0, "—").otherwise(F.date_format(F.timestamp_seconds(seconds), "MMM d, yyyy, hh:mm a"))
