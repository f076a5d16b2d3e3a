"""Queries of the text path, with their SQL."""

from __future__ import annotations

import zlib

from pyspark.sql import functions as F

from docloom.functions import chunker, embed
from docloom.functions import text as T
from docloom.functions import vector as V
from docloom.operators import filters as N
from docloom.plans.search_queries import CURRENT, files_now
from docloom.runtime import ship_package, table
from docloom.sources import listing, office


def chunk_text(spark, sf):
    return chunker.chunk(table(spark, sf, "documents"), "doc_id", "text")


def sanitize_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.sanitize(F.col("text")).alias("text"))


def plain_text_read(spark, sf):
    return table(spark, sf, "documents").where("text is not null").select("doc_id", T.plain_text(F.col("text")).alias("text"))


def pdf_line_repair(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.repair_pdf_lines(F.col("text")).alias("text"))


def path_parts(spark, sf):
    p = F.col("path")
    return files_now(spark, sf).select("id", T.basename(p).alias("name"), T.dirname(p).alias("folder"), T.extension(p).alias("ext"))


def target_filter(spark, sf):
    f = files_now(spark, sf)
    return f.where(N.target(F.col("file_name"), F.col("folder_path"), F.col("size"))).select("id", "path")


def extension_route(spark, sf):
    """What becomes of each file by its extension."""
    return files_now(spark, sf).select("id", T.route(F.col("file_name")).alias("route"))


def path_clean(spark, sf):
    """Paths with dots, doubled separators and steps upward, in their shortest spelling."""
    messy = F.concat(F.col("folder_path"), F.lit("//./x/../"), F.col("file_name"), F.lit("/"))
    up = F.concat(F.lit("../a/../../"), F.col("file_name"))
    posix = files_now(spark, sf).where(~F.col("path").contains("\\") & ~F.col("path").contains(":"))
    return posix.select("id", T.clean_path(messy).alias("path"), T.clean_path(up).alias("up"))


def display_formats(spark, sf):
    """Sizes and times as they are shown."""
    return files_now(spark, sf).select("id", T.format_bytes(F.col("size")).alias("size"), T.format_date(F.col("updated_at")).alias("synced_at"))


def vector_json(spark, sf):
    """Vectors written as JSON and read back: those that come back the same."""
    v = table(spark, sf, "embeddings")
    back = V.from_json(V.to_json(F.col("embedding")))
    return v.select("vec_id", (back == F.col("embedding")).alias("same"), F.size(back).alias("dim"))


def mime_sniff(spark, sf):
    return table(spark, sf, "documents").select("doc_id", N.sniff(F.col("text")).alias("mime"))


def content_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))


def content_hash_xxh64(spark, sf):
    """The 16-digit hash of the bytes; Spark's own function has another seed, so batches go through Arrow."""
    ship_package(spark)

    def run(batches):
        import pyarrow as pa
        import xxhash

        for b in batches:
            h = [None if t is None else f"{xxhash.xxh64_intdigest(t):016x}" for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(h, pa.string())], names=["doc_id", "hash"])

    return table(spark, sf, "documents").select("doc_id", "text").mapInArrow(run, "doc_id long, hash string")


def document_dedup(spark, sf):
    """The first document of each text."""
    d = table(spark, sf, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("hash"))
    return d.groupBy("hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


def _packed(spark, sf, kind):
    """The documents as Office files in memory."""
    ship_package(spark)

    def run(batches):
        import io
        import zipfile
        from xml.sax.saxutils import escape

        import pyarrow as pa

        for b in batches:
            out = []
            for t in b.column(1).to_pylist():
                paragraphs = "".join(f"<p><t>{escape(''.join(c for c in x if c >= ' '))}</t></p>" for x in (t or "").split(chr(10)))
                data = io.BytesIO()
                with zipfile.ZipFile(data, "w") as z:
                    z.writestr("word/document.xml" if kind == "docx" else "ppt/slides/slide1.xml", f"<d>{paragraphs}</d>")
                out.append(data.getvalue())
            yield pa.record_batch([pa.array([f"{i}.{kind}" for i in b.column(0).to_pylist()]), pa.array(out, pa.binary())], names=["path", "content"])

    return table(spark, sf, "documents").select("doc_id", "text").mapInArrow(run, "path string, content binary")


def docx_extract(spark, sf):
    return office.extract_all(_packed(spark, sf, "docx"))


def pptx_extract(spark, sf):
    return office.extract_all(_packed(spark, sf, "pptx"))


def _as_pdf(text: str) -> bytes:
    """A PDF of the text: form feeds part pages, each line is shown by one operator, in UTF-16 units of a font with a Unicode map."""
    units = zlib.compress(b"1 begincodespacerange <0000> <ffff> endcodespacerange 1 beginbfrange <0000> <ffff> <0000> endbfrange")
    objects = [b"<</Type/Catalog/Pages 2 0 R>>", b"", b"<</Type/Font/Subtype/Type0/ToUnicode 4 0 R>>", b"<</Filter/FlateDecode/Length %d>>stream\n%b\nendstream" % (len(units), units)]
    kids = []
    for page in text.split(chr(12)):
        shown = b" T* ".join(b"<%b> Tj" % line.encode("utf-16-be").hex().encode() for line in page.split(chr(10)))
        body = zlib.compress(b"BT /F 12 Tf " + shown + b" ET")
        objects.append(b"<</Filter/FlateDecode/Length %d>>stream\n%b\nendstream" % (len(body), body))
        kids.append(len(objects) + 1)
        objects.append(b"<</Type/Page/Parent 2 0 R/Resources<</Font<</F 3 0 R>>>>/Contents %d 0 R>>" % (len(objects)))
    objects[1] = b"<</Type/Pages/Count %d/Kids[%b]>>" % (len(kids), b" ".join(b"%d 0 R" % k for k in kids))
    return b"%PDF-1.7\n" + b"".join(b"%d 0 obj%b endobj\n" % (i, o) for i, o in enumerate(objects, 1)) + b"trailer<</Root 1 0 R>>\n%%EOF"


def pdf_extract(spark, sf):
    """The documents as PDF files in memory, read back."""
    ship_package(spark)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.record_batch([pa.array([f"{i}.pdf" for i in b.column(0).to_pylist()]), pa.array([_as_pdf(t or "") for t in b.column(1).to_pylist()], pa.binary())], names=["path", "content"])

    return office.extract_all(table(spark, sf, "documents").select("doc_id", "text").mapInArrow(run, "path string, content binary"))


def embed_text(spark, sf):
    return embed.embed(table(spark, sf, "chunks").select("id", "content").distinct(), "id", "content")


def directory_scan(spark, sf):
    return listing.list_tree(spark, [sf]).where("not is_dir").select(T.basename(F.col("path")).alias("name"), "size")


QUERIES = {f.__name__: f for f in (chunk_text, sanitize_text, plain_text_read, pdf_line_repair, path_parts, target_filter, extension_route, path_clean, display_formats, vector_json, mime_sniff, content_hash, content_hash_xxh64, document_dedup, docx_extract, pptx_extract, pdf_extract, embed_text, directory_scan)}

_S = T.SPACE_CLASS


def _clean(x: str) -> str:
    lf = f"replace(replace(replace({x}, chr(0), ''), chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    return rf"regexp_replace(regexp_replace(regexp_replace({lf}, '\n{{3,}}', chr(10) || chr(10), 'g'), '[ \t]+', ' ', 'g'), '^{_S}+|{_S}+$', '', 'g')"


_EXT = r"lower(regexp_extract({p}, '(\.[^./\\]*)$', 1))"
_IN = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
_PAGES = f"list_filter(list_transform(string_split(coalesce(text, ''), chr(12)), lambda x: {_clean('@')}), lambda x: length(x) > 0)"
# What the Office files hold: lines without control characters; what is read: cleaned, empty ones dropped, a blank after each.
_BARE = r"regexp_replace(x, '[\x00-\x1f]', '', 'g')"
_PACKED = f"p AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {_clean(_BARE)}), lambda x: length(x) > 0) AS l FROM documents)"
_OFFICE = "WITH {p} SELECT doc_id || '.{kind}' AS path, CASE WHEN len(l) > 0 THEN array_to_string(l, ' ') END AS text, CASE WHEN len(l) = 0 THEN 'no text' END AS error FROM p"
_HEX = lambda t: "".join(f"({ord(c.upper()):02X}|{ord(c.lower()):02X})" for c in t)
_HTML = "'^3C(" + "|".join(map(_HEX, N.TAGS)) + ")(20|3E)'"
_KINDS = " ".join(f"WHEN regexp_matches(h, '^{p}') THEN '{k}'" for p, k in N.SIGNATURES)
_FIXED = r"replace(regexp_replace(regexp_replace(x, '([a-zA-Z])-\n([a-zA-Z])', '\1\2', 'g'), '([a-zA-Z])\n([a-zA-Z])', '\1\2', 'g'), chr(10), ' ')"
ORACLE = {
    "chunk_text": r"""WITH RECURSIVE w AS (
SELECT doc_id, text, 0 AS idx, CAST(0 AS BIGINT) AS s, CAST(length(text) AS BIGINT) AS n FROM documents WHERE text <> ''
UNION ALL SELECT doc_id, text, idx + 1, CAST(greatest(CASE WHEN length(b) < e - 100 - s THEN e - 100 - length(b) ELSE e - 100 END, s + 1) AS BIGINT), n FROM (
SELECT *, regexp_extract(substring(text, s + 1, e - 100 - s), '[^ \n]*$') AS b FROM (
SELECT *, CASE WHEN length(a) < 150 THEN s + 800 - length(a) ELSE s + 800 END AS e FROM (
SELECT *, regexp_extract(substring(text, s + 652, 150), '[^ \n]*$') AS a FROM w WHERE s + 800 < n))))
SELECT doc_id, CAST(idx AS INT) AS chunk_index, CASE WHEN s + 800 >= n THEN substring(text, s + 1) ELSE substring(text, s + 1, CASE WHEN length(a) < 150 THEN 800 - length(a) ELSE 800 END) END AS content
FROM (SELECT *, regexp_extract(substring(text, s + 652, 150), '[^ \n]*$') AS a FROM w)""",
    "sanitize_text": f"SELECT doc_id, {_clean('text')} AS text FROM documents",
    "plain_text_read": f"SELECT doc_id, array_to_string(l, chr(10)) || CASE WHEN len(l) > 0 THEN chr(10) ELSE '' END AS text FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {_clean('x')}), lambda x: length(x) > 0) AS l FROM documents WHERE text IS NOT NULL)",
    "pdf_line_repair": r"SELECT doc_id, replace(regexp_replace(regexp_replace(text, '([a-zA-Z])-\n([a-zA-Z])', '\1\2', 'g'), '([a-zA-Z])\n([a-zA-Z])', '\1\2', 'g'), chr(10), ' ') AS text FROM documents",
    "path_parts": rf"WITH {CURRENT} SELECT id, regexp_extract(path, '([^/\\]*)[/\\]*$', 1) AS name, regexp_replace(path, '[/\\]+[^/\\]*[/\\]*$', '') AS folder, {_EXT.format(p='path')} AS ext FROM cur",
    "target_filter": rf"WITH {CURRENT} SELECT id, path FROM cur WHERE size BETWEEN 50 AND 104857600 AND NOT regexp_matches(lower(file_name), '^(\.|~\$)|\.(tmp|crdownload|part|download|opdownload|~tmp|bak|log)$') AND lower(file_name) NOT IN {_IN(N.DENIED_NAMES)} AND {_EXT.format(p='file_name')} IN {_IN(N.EXTENSIONS)} AND len(list_filter(regexp_split_to_array(lower(folder_path), '[/\\]'), lambda p: p IN {_IN(N.DENIED_FOLDERS)} OR regexp_matches(p, '^(\.|~\$)'))) = 0",
    "extension_route": rf"WITH {CURRENT} SELECT id, CASE WHEN e = '' THEN 'no extension' WHEN e IN ('.txt', '.md') THEN 'plain' WHEN e IN ('.pdf', '.docx', '.pptx') THEN substring(e, 2) ELSE 'unsupported' END AS route FROM (SELECT id, {_EXT.format(p='file_name')} AS e FROM cur)",
    "content_hash": "SELECT doc_id, sha256(text) AS hash FROM documents",
    "document_dedup": "SELECT sha256(text) AS hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "mime_sniff": f"WITH d AS (SELECT doc_id, substring(hex(encode(text)), 1, 1024) AS h FROM documents), t AS (SELECT *, regexp_replace(h, '^(09|0A|0C|0D|20)+', '') AS x FROM d) SELECT doc_id, CASE WHEN coalesce(h, '') = '' THEN NULL WHEN regexp_matches(x, {_HTML}) THEN 'text/html; charset=utf-8' WHEN regexp_matches(x, '^3C3F{_HEX('xml')}') THEN 'text/xml; charset=utf-8' {_KINDS} WHEN regexp_matches(h, '^(..)*(0[0-8BEF]|1[0-9ACDEF])') THEN 'application/octet-stream' ELSE 'text/plain; charset=utf-8' END AS mime FROM t",
    "docx_extract": _OFFICE.format(p=_PACKED, kind="docx"),
    "pptx_extract": _OFFICE.format(p=_PACKED, kind="pptx"),
    "pdf_extract": f"WITH p AS (SELECT doc_id, regexp_replace(array_to_string({_PAGES.replace('@', _FIXED)}, ' '), '^{_S}+|{_S}+$', '', 'g') AS t FROM documents) SELECT doc_id || '.pdf' AS path, CASE WHEN length(t) > 0 THEN t END AS text, CASE WHEN length(t) = 0 THEN 'no text' END AS error FROM p",
    "path_clean": rf"WITH {CURRENT}, c AS (SELECT id, folder_path || '/' || file_name AS path, '../../' || file_name AS up FROM cur WHERE NOT contains(path, chr(92)) AND NOT contains(path, ':')) SELECT id, regexp_replace(path, '//+', '/', 'g') AS path, up FROM c",
    "display_formats": f"WITH {CURRENT} SELECT id, CASE WHEN size = 0 THEN '0 B' WHEN size < 1024 THEN printf('%.1f B', size::DOUBLE) WHEN size < 1048576 THEN printf('%.1f KB', size / 1024.0) WHEN size < 1073741824 THEN printf('%.1f MB', size / 1048576.0) ELSE printf('%.1f GB', size / 1073741824.0) END AS size, CASE WHEN coalesce(updated_at, 0) = 0 THEN '—' ELSE strftime(to_timestamp(updated_at) AT TIME ZONE 'UTC', '%b %-d, %Y, %I:%M %p') END AS synced_at FROM cur",
    "vector_json": "SELECT vec_id, to_json(embedding)::FLOAT[] = embedding AS same, CAST(len(embedding) AS INT) AS dim FROM embeddings",
}
