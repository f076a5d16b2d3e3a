"""Queries of the llm problems, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.text import SPACE_CLASS as _SPACE
from docloom.llm import ann, fusion, leakage, neardup, quality, splitting, tokenizer
from docloom.runtime import materialize, table


def _lists(spark: SparkSession, sf: str) -> list[fusion.Scores]:
    return [
        fusion.Scores(table(spark, sf, "vec_hits"), "distance"),
        fusion.Scores(table(spark, sf, "fts_chunks"), "rank"),
        fusion.Scores(table(spark, sf, "search_result"), "combined_score", ascending=False),
    ]


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best chunks of each query by Borda count, of those near the top of at least two lists."""
    return fusion.borda(_lists(spark, sf), "query_id", "chunk_id", top=10, among=15).select("query_id", "chunk_id")


def p2_borda(spark: SparkSession, sf: str) -> DataFrame:
    """Points of every chunk of every query."""
    return fusion.borda(_lists(spark, sf), "query_id", "chunk_id").select("query_id", "chunk_id", "points")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.oversized(table(spark, sf, "chunks"), "id", "content").select(F.col("id").alias("chunk_id"), "reason")


def p3_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """All chunks in pieces of at most 800 characters, numbered anew within their documents."""
    rows = table(spark, sf, "chunks").where("id is not null").select("id", "document_hash", "chunk_index", "content")
    # One row for each id: only the texts of ids that have several are shuffled.
    again = materialize(rows.groupBy("id").count().where("count > 1").select("id"), "again")
    again = F.broadcast(again) if again.count() <= splitting.BROADCAST_ROWS else again
    several = rows.join(again, "id", "left_semi").groupBy("id").agg(F.min(F.struct(F.col("document_hash").isNull().alias("z"), "document_hash", "chunk_index", "content")).alias("m"))
    several = materialize(several.select("id", "m.document_hash", "m.chunk_index", "m.content"), "several")
    texts = rows.join(again, "id", "left_anti").unionByName(several)
    first = texts.select("id", "document_hash", "chunk_index")
    pieces = splitting.split_oversized(texts, "id", "content")
    out = splitting.renumbered(pieces, first, "id", "document_hash", "chunk_index")
    return out.select("document_hash", "chunk_index", F.col("id").alias("chunk_id"), "content")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return ann.similar_pairs(table(spark, sf, "vec_chunks"), "chunk_id", "embedding", floor=0.8, k=10)


def p4_knn(spark: SparkSession, sf: str) -> DataFrame:
    """The ten most similar vectors of every chunk whose id is divisible by 50, against all."""
    near = ann.similar(table(spark, sf, "vec_chunks"), "chunk_id", "embedding", k=10, base_cells=1, query_cells=48, query_every=50, shortlist=64, subspaces=96)
    return near.select(F.col("id").alias("chunk_id"), "neighbour", F.round("cosine", 6).alias("cosine"), "rank")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.near_duplicate_pairs(table(spark, sf, "chunks"), "id", "content", size=2, similarity=0.6, least=80)


def p5_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Each chunk of enough words with its group of near duplicates and its number of links."""
    members, links = neardup.near_duplicates(table(spark, sf, "chunks"), "id", "content", size=2, similarity=0.6, least=80)
    return neardup.groups(members, links)


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokenizer.encode_corpus(table(spark, sf, "documents"), "doc_id", "text")


def _spans(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaked_spans(table(spark, sf, "documents"), "doc_id", "text", table(spark, sf, "eval_items"), "item_id", "text")


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return _spans(spark, sf).select("doc_id", "item_id").distinct()


def p8_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of words to remove from each document."""
    return _spans(spark, sf)


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    found = quality.judge(table(spark, sf, "documents"), "doc_id", "text", table(spark, sf, "doc_labels"), "doc_id", "kind", "lang")
    return found.where("rule > 0").select(F.col("id").alias("doc_id"))


def p9_stats(spark: SparkSession, sf: str) -> DataFrame:
    return quality.statistics(table(spark, sf, "documents"), "doc_id", "text")


QUERIES = {f.__name__: f for f in (p2_found, p2_borda, p3_found, p3_pieces, p4_found, p4_knn, p5_found, p5_groups, p7_ids, p8_found, p8_spans, p9_found, p9_stats)}

_KEEP = r"[\p{L}\p{N}" + _SPACE[1:]
_LISTS = """lists AS (
SELECT 0 AS l, query_id, chunk_id, distance AS v FROM vec_hits UNION ALL SELECT 1, query_id, chunk_id, rank FROM fts_chunks
UNION ALL SELECT 2, query_id, chunk_id, -combined_score FROM search_result),
best AS (SELECT l, query_id, chunk_id, min(v) AS v FROM lists WHERE query_id IS NOT NULL AND chunk_id IS NOT NULL AND v IS NOT NULL AND NOT isnan(v) GROUP BY ALL),
ranked AS (SELECT *, rank() OVER w AS r, count(*) OVER (PARTITION BY l, query_id, v) AS ties, count(*) OVER (PARTITION BY l, query_id) AS n FROM best WINDOW w AS (PARTITION BY l, query_id ORDER BY v)),
items AS (SELECT query_id, chunk_id, count(*) FILTER (r <= 15) AS good FROM ranked GROUP BY ALL),
sizes AS (SELECT query_id, count(*) AS u FROM items GROUP BY ALL),
points AS (SELECT i.query_id, i.chunk_id, i.good, sum(CASE WHEN r.r IS NULL THEN (u - coalesce(c.n, 0) - 1) / 2.0 ELSE u - (r.r + (r.ties - 1) / 2.0) END) AS points
FROM items i JOIN sizes USING (query_id) CROSS JOIN (VALUES (0), (1), (2)) t(l) LEFT JOIN ranked r ON r.l = t.l AND r.query_id = i.query_id AND r.chunk_id = i.chunk_id
LEFT JOIN (SELECT DISTINCT l, query_id, n FROM ranked) c ON c.l = t.l AND c.query_id = i.query_id GROUP BY ALL)"""
# Brute force over all pairs: for small tables only.
_COSINES = """vec AS (SELECT DISTINCT chunk_id, embedding::DOUBLE[384] AS e FROM vec_chunks WHERE chunk_id IS NOT NULL AND len(embedding) = 384
AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
cosines AS (SELECT a.chunk_id AS id, b.chunk_id AS neighbour, max(array_cosine_similarity(a.e, b.e)) AS cosine FROM vec a, vec b WHERE a.chunk_id <> b.chunk_id {extra} GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(cosine, 12) DESC, neighbour) AS rank FROM cosines QUALIFY rank <= 10)"""
_BIGRAMS = r"""w AS (SELECT id, list_filter(regexp_split_to_array(lower(min(content)), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM chunks WHERE id IS NOT NULL AND content IS NOT NULL GROUP BY id),
s AS (SELECT id, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS s FROM w), g AS (SELECT id, len(s) AS n, unnest(s) AS g FROM s WHERE len(s) >= 80),
pairs AS (SELECT a.id AS id_a, b.id AS id_b FROM g a JOIN g b ON a.g = b.g AND a.id < b.id GROUP BY a.id, b.id, a.n, b.n HAVING count(*) >= 0.6 * (a.n + b.n - count(*)) - 1e-9)"""
# Words without case and accents; the compatibility characters that the texts hold are replaced one by one.
_PLAIN = r"strip_accents(lower(replace(replace(replace(replace(replace(replace(replace(regexp_replace({t}, '(\p{{L}}\p{{M}}*)[-‐‑­][\t\x0B\f \x{{A0}}]*(\r\n|\n|\r)\s*(\p{{L}})', '\1\3', 'g'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬀ', 'ff'), 'ﬃ', 'ffi'), 'ﬄ', 'ffl'), 'ß', 'ss'), 'ẞ', 'ss')))"
_GRAMS = r"{n} AS (SELECT {id}, list_filter(regexp_split_to_array({plain}, '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM {t} WHERE {id} IS NOT NULL AND text IS NOT NULL), {n}g AS (SELECT DISTINCT {id}, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT {id}, w, unnest(range(1, len(w) - 10)) AS i FROM {n}))"
_LEAKS = ", ".join(_GRAMS.format(n=n, id=i, t=t, plain=_PLAIN.format(t="text")) for n, i, t in (("d", "doc_id", "documents"), ("e", "item_id", "eval_items")))
ORACLE = {
    "p4_found": f"WITH {_COSINES.format(extra='')} SELECT DISTINCT least(id, neighbour) AS id_a, greatest(id, neighbour) AS id_b FROM best WHERE cosine >= 0.8",
    "p4_knn": f"WITH {_COSINES.format(extra='AND a.chunk_id % 50 = 0')} SELECT id AS chunk_id, neighbour, round(cosine, 6) AS cosine, CAST(rank AS INT) AS rank FROM best",
    "p5_found": f"WITH {_BIGRAMS} SELECT id_a, id_b FROM pairs",
    "p5_groups": f"""WITH RECURSIVE {_BIGRAMS}, c AS (SELECT id, min(id) OVER (PARTITION BY list_sort(s)) AS rep FROM s WHERE len(s) >= 80),
links AS (SELECT id_a AS a, id_b AS b FROM pairs WHERE id_a IN (SELECT rep FROM c) AND id_b IN (SELECT rep FROM c)), edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT DISTINCT rep AS v, rep AS w FROM c UNION SELECT v, b FROM reach JOIN edges ON a = w)
SELECT id, (SELECT min(w) FROM reach WHERE v = rep) AS group_id, (SELECT count(*) FROM edges WHERE a = rep) AS links FROM c""",
    "p8_spans": f"""WITH {_LEAKS}, hits AS (SELECT DISTINCT doc_id, item_id, i FROM (SELECT doc_id, array_to_string(w[i:i + 11], ' ') AS g, i - 1 AS i FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM d)) JOIN eg USING (g)),
marks AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id, item_id ORDER BY i) <= 12 THEN 0 ELSE 1 END AS new FROM hits),
islands AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, item_id ORDER BY i) AS k FROM marks)
SELECT doc_id, item_id, min(i) AS first_word, max(i) + 11 AS last_word FROM islands GROUP BY doc_id, item_id, k""",
    "p8_found": f"WITH {_LEAKS} SELECT DISTINCT doc_id, item_id FROM dg JOIN eg USING (g)",
    "p2_found": f"WITH {_LISTS} SELECT query_id, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY points DESC, chunk_id) AS k FROM points WHERE good >= 2) WHERE k <= 10",
    "p2_borda": f"WITH {_LISTS} SELECT query_id, chunk_id, CAST(points AS DOUBLE) AS points FROM points",
    "p3_found": rf"""SELECT DISTINCT id AS chunk_id, reason FROM (
SELECT id, 'long' AS reason FROM chunks WHERE length(content) > 800 UNION ALL
SELECT id, 'unbroken' FROM chunks WHERE len(list_filter(regexp_split_to_array(content, '{_SPACE}'), lambda s: length(s) > 800)) > 0)""",
    "p9_stats": rf"""WITH d AS (SELECT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND length(regexp_replace(text, '{_SPACE}', '', 'g')) > 0),
top AS (SELECT w FROM (SELECT unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')) AS w FROM documents) GROUP BY w ORDER BY count(*) DESC, w LIMIT 100),
parts AS (SELECT doc_id, text, len(list_filter(regexp_split_to_array(text, '{_SPACE}+'), lambda x: x <> '')) AS words, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS own,
list_filter(regexp_split_to_array(text, '\r\n|\n|\r'), lambda x: length(regexp_replace(x, '{_SPACE}', '', 'g')) > 0) AS lines FROM d)
SELECT doc_id, CAST(words AS INT) AS word_count, round(length(regexp_replace(text, '{_SPACE}', '', 'g')) / words, 6) AS mean_word_length,
round(length(regexp_replace(text, '{_KEEP}', '', 'g')) / length(text), 6) AS symbol_ratio,
round(len(list_filter(lines, lambda x: regexp_matches(x, '[.!?…:;]{_SPACE}*$'))) / len(lines), 6) AS line_end_ratio,
round(len(list_filter(own, lambda x: list_contains(l, x))) / greatest(len(own), 1), 6) AS common_ratio FROM parts, (SELECT list(w) AS l FROM top)""",
}
