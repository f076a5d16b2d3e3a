"""Queries of search, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.functions import vector as V
from docloom.operators import search as S
from docloom.operators.incremental import current_rows
from docloom.runtime import materialize, table

DIM, PHRASE, CUTOFF = 384, ["has", "to", "be"], 0.8


def files_now(spark: SparkSession, sf: str) -> DataFrame:
    return current_rows(table(spark, sf, "files"), "id", "updated_at", "loaded_at")


def query_vector(vectors: DataFrame, key: str, dim: int) -> list[float]:
    """The first usable vector."""
    row = vectors.where(V.usable(F.col("embedding"), dim)).orderBy(key).select("embedding").first()
    return list(row[0]) if row else []


def _all(spark, sf):
    v = table(spark, sf, "vec_chunks")
    return v, table(spark, sf, "chunks"), files_now(spark, sf), query_vector(v, "chunk_id", DIM)


def queries_with_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """All search queries, each with the vector of its nearest vector hit that has a usable one (the least of the chunk's
    vectors), as if an embedder had given it."""
    v = table(spark, sf, "vec_chunks").where(V.usable(F.col("embedding"), DIM) & F.col("chunk_id").isNotNull())
    hits = table(spark, sf, "vec_hits").where("distance is not null and not isnan(distance)").join(v.groupBy("chunk_id").agg(F.min("embedding").alias("embedding")), "chunk_id")
    best = hits.groupBy("query_id").agg(F.min(F.struct("distance", "chunk_id", "embedding")).alias("b"))
    return table(spark, sf, "search_queries").join(best.select("query_id", F.col("b.embedding").alias("embedding")), "query_id", "left")


def search_batch(spark, sf):
    """Search for all queries of the table, semantic or hybrid as each asks, with the files found."""
    found = S.search_batch(table(spark, sf, "vec_chunks"), table(spark, sf, "chunks"), files_now(spark, sf), queries_with_vectors(spark, sf), DIM)
    return found.select("query_id", "chunk_id", "file_path", "combined_score")


def knn_batch(spark, sf):
    """The nearest chunks of all queries."""
    near = S.knn_batch(table(spark, sf, "vec_chunks"), queries_with_vectors(spark, sf), DIM)
    return near.select("query_id", "chunk_id", F.round("distance", 6).alias("distance"))


def keyword_batch(spark, sf):
    """Phrase matches of all queries, ranked by BM25."""
    words = materialize(S.corpus_words(table(spark, sf, "chunks")), "words")
    return S.keyword_batch(words, S.phrases_of(table(spark, sf, "search_queries"))).select("query_id", "chunk_id", F.round("rank", 6).alias("rank"))


def search_files(spark, sf):
    """The search call on a quoted text, with the built-in embedder."""
    return S.search(table(spark, sf, "vec_chunks"), table(spark, sf, "chunks"), files_now(spark, sf), ' "has to be" ')


def knn_l2_topk(spark, sf):
    v = table(spark, sf, "embeddings")
    return S.knn(v, query_vector(v, "vec_id", 64), 64, key="vec_id").select("vec_id", F.round("distance", 6).alias("distance"))


def knn_chunks(spark, sf):
    v = table(spark, sf, "vec_chunks")
    return S.knn(v, query_vector(v, "chunk_id", DIM), DIM).select("chunk_id", F.round("distance", 6).alias("distance"))


def semantic_search(spark, sf):
    v, c, f, q = _all(spark, sf)
    return S.semantic_search(v, c, f, q, DIM)


def semantic_search_files(spark, sf):
    return S.best_files(semantic_search(spark, sf))


def keyword_phrase_match(spark, sf):
    return S.phrase_matches(table(spark, sf, "chunks"), PHRASE).where("tf > 0")


def keyword_bm25(spark, sf):
    return S.bm25(S.phrase_matches(table(spark, sf, "chunks"), PHRASE)).select("chunk_id", F.round("rank", 6).alias("rank"))


def rrf_fusion(spark, sf):
    v, c, _, q = _all(spark, sf)
    return S.reciprocal_ranks(S.knn(v, q, DIM), S.bm25(S.phrase_matches(c, PHRASE)))


def hybrid_search(spark, sf):
    v, c, f, q = _all(spark, sf)
    return S.hybrid_search(v, c, f, q, DIM, PHRASE)


def hybrid_search_files(spark, sf):
    return S.best_files(hybrid_search(spark, sf))


def cosine_similarity(spark, sf):
    v = table(spark, sf, "embeddings")
    return v.select("vec_id", F.round(V.cosine(F.col("embedding"), V.literal(query_vector(v, "vec_id", 64))), 6).alias("cosine"))


def vector_normalize(spark, sf):
    v = table(spark, sf, "vec_chunks").where(V.usable(F.col("embedding"), DIM))
    return V.distinct_vectors(v.select("chunk_id", F.transform(V.normalize(F.col("embedding")), lambda x: V.rounded(x)).alias("unit")), "chunk_id", "unit")


def vector_mean_pool(spark, sf):
    """Mean vector of each label, dimension by dimension."""
    v = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    means = v.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.select("label", "pos", F.round("m", 6).alias("mean"))


def l2_norm(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.round(V.norm(F.col("embedding")), 6).alias("norm"))


def fts_query_sanitize(spark, sf):
    return table(spark, sf, "search_queries").select("query_id", T.phrase(F.col("query_text")).alias("phrase"))


def _q(f):
    return f.__name__, f


QUERIES = dict(map(_q, (knn_l2_topk, knn_chunks, semantic_search, semantic_search_files, keyword_phrase_match, keyword_bm25, rrf_fusion, hybrid_search, hybrid_search_files, search_batch, knn_batch, keyword_batch, search_files, cosine_similarity, vector_normalize, vector_mean_pool, l2_norm, fts_query_sanitize)))

CURRENT = "cur AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, loaded_at) AS k FROM files WHERE id IS NOT NULL) WHERE k = 1)"
_USABLE = "vec AS (SELECT chunk_id, embedding FROM vec_chunks WHERE chunk_id IS NOT NULL AND len(embedding) = 384 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)"
_L2 = "sqrt(list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))))"
_NEAR = _USABLE + ", q AS (SELECT embedding AS e FROM vec ORDER BY chunk_id LIMIT 1), near AS (SELECT chunk_id, min(" + _L2.format(a="embedding", b="e") + ") AS distance FROM vec, q GROUP BY chunk_id ORDER BY distance, chunk_id LIMIT 50)"
_FOLD = f"translate(lower(content), '{T.ACCENTED}', '{T.PLAIN}')"
_WORDS = (
    "one AS (SELECT id AS chunk_id, min(struct_pack(h := document_hash, c := content)) AS s FROM chunks WHERE id IS NOT NULL GROUP BY id), text AS (SELECT chunk_id, s.h AS document_hash, s.c AS content FROM one), "
    f"words AS (SELECT chunk_id, list_filter(regexp_split_to_array({_FOLD}, '[^\\p{{L}}\\p{{N}}\\p{{Co}}]+'), lambda x: x <> '') AS w FROM text WHERE content IS NOT NULL), "
    f"matches AS (SELECT chunk_id, len(list_filter(range(1, len(w) - {len(PHRASE) - 2}), lambda i: w[i:i + {len(PHRASE) - 1}] = {PHRASE})) AS tf, len(w) AS dl FROM words)"
)
_BM25 = _WORDS + (
    ", st AS (SELECT count(*) AS n, avg(dl) AS avgdl, count(*) FILTER (tf > 0) AS df FROM matches), "
    "bm AS (SELECT chunk_id, -(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS rank FROM matches, st WHERE tf > 0)"
)
_RRF = f"{_NEAR}, {_BM25}, a AS (SELECT chunk_id, row_number() OVER (ORDER BY distance, chunk_id) AS r FROM near), b AS (SELECT chunk_id, row_number() OVER (ORDER BY rank, chunk_id) AS s FROM bm), fused AS (SELECT chunk_id, round(coalesce(1.0::DOUBLE / (60 + r), 0) + coalesce(1.0::DOUBLE / (60 + s), 0), 9) AS combined_score FROM a FULL JOIN b USING (chunk_id))"
_ASKED = _USABLE + (
    ", least AS (SELECT chunk_id, min(embedding) AS e FROM vec GROUP BY chunk_id), hit AS (SELECT query_id, arg_min(e, struct_pack(d := distance, c := chunk_id)) AS e FROM vec_hits JOIN least USING (chunk_id) WHERE distance IS NOT NULL AND NOT isnan(distance) GROUP BY query_id), "
    "asked AS (SELECT q.*, h.e FROM search_queries q LEFT JOIN hit h USING (query_id))"
)
_NEARS = (
    "dist AS (SELECT query_id, chunk_id, min(" + _L2.format(a="embedding", b="e") + ") AS distance FROM asked, vec WHERE e IS NOT NULL GROUP BY query_id, chunk_id), "
    "nears AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS r FROM dist QUALIFY r <= 50)"
)
_SAID = (
    "one AS (SELECT id AS chunk_id, min(struct_pack(h := document_hash, c := content)) AS s FROM chunks WHERE id IS NOT NULL GROUP BY id), text AS (SELECT chunk_id, s.h AS document_hash, s.c AS content FROM one), "
    f"words AS (SELECT chunk_id, list_filter(regexp_split_to_array({_FOLD}, '[^\\p{{L}}\\p{{N}}\\p{{Co}}]+'), lambda x: x <> '') AS w FROM text WHERE content IS NOT NULL), "
    f"phrase AS (SELECT query_id, list_filter(regexp_split_to_array({_FOLD.replace('content', 'query_text')}, '[^\\p{{L}}\\p{{N}}\\p{{Co}}]+'), lambda x: x <> '') AS p FROM search_queries), "
    "matches AS (SELECT query_id, chunk_id, len(list_filter(range(1, len(w) - len(p) + 2), lambda i: w[i:i + len(p) - 1] = p)) AS tf, len(w) AS dl FROM words, phrase WHERE len(p) > 0), "
    "st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM words), dfs AS (SELECT query_id, count(*) AS df FROM matches WHERE tf > 0 GROUP BY query_id), "
    "said AS (SELECT query_id, chunk_id, -(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS rank FROM matches JOIN dfs USING (query_id), st WHERE tf > 0)"
)
_ONE = "one AS (SELECT id AS chunk_id, min(struct_pack(h := document_hash, c := content)) AS s FROM chunks WHERE id IS NOT NULL GROUP BY id), text AS (SELECT chunk_id, s.h AS document_hash, s.c AS content FROM one)"
_SEM = f"{CURRENT}, {_NEAR}, {_ONE}, res AS (SELECT chunk_id, file_name, path AS file_path, content, round(1 - distance, 6) AS combined_score FROM near JOIN text USING (chunk_id) JOIN cur ON file_hash = document_hash WHERE distance <= 0.8)"
_HYB = f"{CURRENT}, {_RRF}, res AS (SELECT chunk_id, file_name, path AS file_path, content, combined_score FROM fused JOIN text USING (chunk_id) JOIN cur ON file_hash = document_hash)"
_FILES = "SELECT file_path, file_name FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY combined_score DESC, chunk_id) AS k FROM res) WHERE k = 1"
_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"
_NORM = "sqrt(list_sum(list_transform({a}, lambda x: x::DOUBLE * x::DOUBLE)))"
ORACLE = {
    "knn_l2_topk": f"WITH q AS (SELECT embedding AS e FROM embeddings ORDER BY vec_id LIMIT 1) SELECT vec_id, round({_L2.format(a='embedding', b='e')}, 6) AS distance FROM embeddings, q ORDER BY {_L2.format(a='embedding', b='e')}, vec_id LIMIT 50",
    "knn_chunks": f"WITH {_NEAR} SELECT chunk_id, round(distance, 6) AS distance FROM near",
    "semantic_search": f"WITH {_SEM} SELECT * FROM res",
    "semantic_search_files": f"WITH {_SEM} {_FILES}",
    "keyword_phrase_match": f"WITH {_WORDS} SELECT chunk_id, CAST(tf AS INT) AS tf, CAST(dl AS INT) AS dl FROM matches WHERE tf > 0",
    "keyword_bm25": f"WITH {_BM25} SELECT chunk_id, round(rank, 6) AS rank FROM bm",
    "rrf_fusion": f"WITH {_RRF} SELECT * FROM fused",
    "hybrid_search": f"WITH {_HYB} SELECT * FROM res",
    "hybrid_search_files": f"WITH {_HYB} {_FILES}",
    "knn_batch": f"WITH {_ASKED}, {_NEARS} SELECT query_id, chunk_id, round(distance, 6) AS distance FROM nears",
    "keyword_batch": f"WITH {_SAID} SELECT query_id, chunk_id, round(rank, 6) AS rank FROM said",
    "search_batch": f"""WITH {CURRENT}, {_ASKED}, {_NEARS}, {_SAID}, kind AS (SELECT query_id, coalesce(hybrid, true) AS hybrid FROM search_queries WHERE length(trim(query_text)) > 0),
places AS (SELECT s.*, row_number() OVER (PARTITION BY query_id ORDER BY rank, chunk_id) AS s FROM said s),
fused AS (SELECT query_id, chunk_id, round(coalesce(1.0::DOUBLE / (60 + r), 0) + coalesce(1.0::DOUBLE / (60 + s), 0), 9) AS combined_score FROM nears FULL JOIN places USING (query_id, chunk_id) JOIN kind USING (query_id) WHERE hybrid
UNION ALL SELECT query_id, chunk_id, round(1 - distance, 6) FROM nears JOIN kind USING (query_id) WHERE NOT hybrid AND distance <= 0.8)
SELECT query_id, chunk_id, path AS file_path, combined_score FROM fused JOIN text USING (chunk_id) JOIN cur ON file_hash = document_hash""",
    "cosine_similarity": f"WITH q AS (SELECT embedding AS e FROM embeddings ORDER BY vec_id LIMIT 1) SELECT vec_id, round({_DOT.format(a='embedding', b='e')} / ({_NORM.format(a='embedding')} * {_NORM.format(a='e')}), 6) AS cosine FROM embeddings, q",
    "vector_normalize": f"WITH {_USABLE} SELECT DISTINCT chunk_id, list_transform(embedding, lambda x: round(x::DOUBLE / n, 6)) AS unit FROM (SELECT *, {_NORM.format(a='embedding')} AS n FROM vec)",
    "vector_mean_pool": "SELECT label, CAST(pos AS INT) AS pos, round(avg(x::DOUBLE), 6) AS mean FROM (SELECT label, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS pos FROM embeddings) GROUP BY ALL",
    "l2_norm": f"SELECT vec_id, round({_NORM.format(a='embedding')}, 6) AS norm FROM embeddings",
    "fts_query_sanitize": "SELECT query_id, '\"' || replace(query_text, '\"', '') || '\"' AS phrase FROM search_queries",
}
