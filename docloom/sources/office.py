"""Readers of plain text, Office documents and PDF: content in, (text, error) out, never an exception."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame

from docloom.functions.text import TORN_BY_HYPHEN, TORN_BY_LINE
from docloom.runtime import ship_package
from docloom.sources import pdf

#: Reads a PDF's pages: bytes to a list of page texts (None for a bad page). The built-in one is pdf.pages.
PdfReader = Callable[[bytes], list[str | None]]
EMPTY = "no text"
LONGEST_LINE = 10 * 1024 * 1024


def clean(text: str) -> str:
    text = text.replace("\x00", "").replace("\r\n", "\n").replace("\r", "\n")
    return re.sub(r"[ \t]+", " ", re.sub(r"\n{3,}", "\n\n", text)).strip()


def xml_text(data: bytes) -> str:
    """The text runs of an Office XML part, a blank after each paragraph; text outside paragraphs at the end."""
    out, run = [], []
    for event, node in ElementTree.iterparse(io.BytesIO(data), events=("end",)):
        name = node.tag.rpartition("}")[2]
        if name == "t":
            run.append(node.text or "")
        elif name == "p":
            if part := clean("".join(run)):
                out.append(part + " ")
            run = []
            node.clear()
    if part := clean("".join(run)):
        out.append(part)
    return "".join(out)


def read_plain(data: bytes) -> str:
    """The lines of a text file; a line of more than LONGEST_LINE bytes is an error."""
    if len(data) > LONGEST_LINE and any(len(s) > LONGEST_LINE for s in data.split(b"\n")):
        raise ValueError("line too long")
    lines = (clean(s) for s in data.decode("utf-8", "ignore").split("\n"))
    return "".join(s + "\n" for s in lines if s)


def read_docx(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        if "word/document.xml" not in z.namelist():
            raise ValueError("word/document.xml is missing")
        return xml_text(z.read("word/document.xml"))


def read_pptx(data: bytes) -> str:
    """Slides by their numbers; a slide that can't be read is left out."""
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        numbers = [(int(m[1]), m[0]) for m in (re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n) for n in z.namelist()) if m]
        for _, name in sorted(numbers):
            try:
                text = xml_text(z.read(name)).replace("\n", " ").strip()
            except (ElementTree.ParseError, zipfile.BadZipFile):
                continue
            if text:
                out.append(text)
    return " ".join(out)


def repair(page: str) -> str:
    """Words torn by hyphens or line ends put together."""
    return re.sub(TORN_BY_LINE, r"\1\2", re.sub(TORN_BY_HYPHEN, r"\1\2", page)).replace("\n", " ")


def read_pdf(data: bytes, reader: PdfReader | None) -> str:
    return " ".join(p for p in (clean(repair(page)) for page in (reader or pdf.pages)(data) if page) if p)


def extract(path: str, data: bytes | None, reader: PdfReader | None = None) -> tuple[str | None, str | None]:
    """(text, error) of one file by its extension."""
    name = re.split(r"[/\\]", path or "")[-1]
    ext = name[name.rfind(".") :].lower() if "." in name else ""
    readers = {".txt": read_plain, ".md": read_plain, ".docx": read_docx, ".pptx": read_pptx, ".pdf": lambda d: read_pdf(d, reader)}
    if not ext:
        return None, "no extension"
    if ext not in readers:
        return None, f"unsupported extension {ext}"
    try:
        text = readers[ext](data or b"").strip()
    except Exception as e:  # noqa: BLE001 - a bad file is a row with an error
        return None, f"unreadable {ext}: {e}"
    return (text, None) if text else (None, EMPTY)


def extract_all(files: DataFrame, path: str = "path", content: str = "content", reader: PdfReader | None = None) -> DataFrame:
    """(path, text, error) of files with their content."""
    ship_package(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                got = [extract(p, d, reader) for p, d in zip(part.column(0).to_pylist(), part.column(1).to_pylist())]
                yield pa.record_batch([part.column(0), pa.array([t for t, _ in got], pa.string()), pa.array([e for _, e in got], pa.string())], names=["path", "text", "error"])

    return files.select(files[path].alias("path"), files[content].cast("binary").alias("content")).mapInArrow(run, "path string, text string, error string")
