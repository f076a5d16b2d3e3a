"""Search over chunks: nearest neighbours, phrases ranked by BM25, fusion by reciprocal ranks, and files as results.

Candidates are cut to k before they are joined, so chunks and files are touched for candidates only. Ties go to the
smaller chunk id, then to the smaller path. Empty tables give empty results; null and unusable vectors, null contents
and null keys are no candidates.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.functions import topk
from docloom.functions import vector as V
from docloom.functions.embed import DIM, Embedder, hashing
from docloom.runtime import materialize, ship_package

K, CUTOFF, RRF = 50, 0.8, 60
K1, B = 1.2, 0.75
#: Queries whose vectors (of 384 floats: 12 MB) a pass over the corpus takes.
QUERY_BLOCK = 8_192
#: Rows of the tables of queries and candidates that are broadcast at most.
BROADCAST_ROWS = 200_000
NEAR = "query_id long, key long, distance double"
RESULT = ["chunk_id", "file_name", "file_path", "content", "combined_score"]


def knn_batch(vectors: DataFrame, queries: DataFrame, dim: int, k: int = K, key: str = "chunk_id") -> DataFrame:
    """(query_id, key, distance) of the k nearest vectors by L2 of each query (query_id, embedding).

    Each task keeps the k nearest of its vectors, so at most tasks * k rows a query are shuffled. Queries are taken in
    blocks of QUERY_BLOCK (their vectors are broadcast); unusable ones have no result, rows of one key count once.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    wanted = queries.where(F.col("query_id").isNotNull() & V.usable(F.col("embedding"), dim)).select(F.col("query_id").cast("long").alias("query_id"), "embedding").distinct()
    src, found = vectors.select(F.col(key).cast("long").alias("key"), F.col("embedding").cast("array<float>").alias("embedding")), None
    blocks = max(1, -(-wanted.count() // QUERY_BLOCK))
    for block in range(blocks):
        got = wanted.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).toArrow()
        if got.num_rows:
            names = np.asarray(got.column("query_id"))
            asked = np.asarray(got.column("embedding").combine_chunks().flatten(), np.float32).reshape(-1, dim)
            near = src.mapInArrow(topk.nearest(spark.sparkContext.broadcast((names, asked)), dim, k), NEAR)
            found = near if found is None else found.unionByName(near)
    found = spark.createDataFrame([], NEAR) if found is None else found
    best = found.groupBy("query_id", "key").agg(F.min("distance").alias("distance"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "key"))
    return best.withColumn("place", place).where(F.col("place") <= k).select("query_id", F.col("key").alias(key), "distance")


def knn(vectors: DataFrame, query: list[float], dim: int, k: int = K, key: str = "chunk_id") -> DataFrame:
    """(key, distance) of the k nearest vectors by L2, the nearest first; rows of one key count once."""
    one = vectors.sparkSession.createDataFrame([(0, [float(x) for x in query])], "query_id long, embedding array<float>")
    return knn_batch(vectors, one, dim, k, key).select(key, "distance").orderBy("distance", key)


def contents(chunks: DataFrame) -> DataFrame:
    """One row for each chunk id."""
    return chunks.where("id is not null").groupBy(F.col("id").alias("chunk_id")).agg(F.min(F.struct("document_hash", "content")).alias("c")).select("chunk_id", "c.document_hash", "c.content")


def all_contents(chunks: DataFrame) -> DataFrame:
    """contents() of a whole corpus: only the texts of ids that have several rows are shuffled."""
    rows = chunks.where("id is not null").select(F.col("id").alias("chunk_id"), "document_hash", "content")
    again = materialize(rows.groupBy("chunk_id").count().where("count > 1").select("chunk_id"), "again")
    again = F.broadcast(again) if again.count() <= BROADCAST_ROWS else again
    several = rows.join(again, "chunk_id", "left_semi").groupBy("chunk_id").agg(F.min(F.struct("document_hash", "content")).alias("c"))
    return rows.join(again, "chunk_id", "left_anti").unionByName(several.select("chunk_id", "c.document_hash", "c.content"))


def with_files(found: DataFrame, chunks: DataFrame, files: DataFrame) -> DataFrame:
    """Candidates with chunk contents and every file of the chunk's document."""
    wanted = contents(chunks.join(found.select(F.col("chunk_id").alias("id")), "id", "left_semi"))
    owners = files.select(F.col("file_hash").alias("document_hash"), "file_name", F.col("path").alias("file_path"))
    return found.join(wanted, "chunk_id").join(owners, "document_hash")


def _ordered(results: DataFrame) -> DataFrame:
    """Best first."""
    return results.select(*RESULT).orderBy(F.desc("combined_score"), "chunk_id", "file_path")


def semantic_search(vectors: DataFrame, chunks: DataFrame, files: DataFrame, query: list[float], dim: int, k: int = K, cutoff: float = CUTOFF) -> DataFrame:
    """Chunks within the cutoff among the k nearest, with every file that holds them, the nearest first."""
    near = knn(vectors, query, dim, k).where(F.col("distance") <= cutoff)
    return _ordered(with_files(near, chunks, files).withColumn("combined_score", F.round(1 - F.col("distance"), 6)))


def corpus_words(chunks: DataFrame) -> DataFrame:
    """(chunk_id, dl, words) of each chunk with content: what a keyword index holds. Written once at ingest, it serves
    all searches."""
    words = all_contents(chunks).where("content is not null").select("chunk_id", T.tokens(F.col("content")).alias("words"))
    return words.select("chunk_id", F.size("words").alias("dl"), "words")


def phrase_matches(chunks: DataFrame, phrase: list[str], words: DataFrame | None = None) -> DataFrame:
    """(chunk_id, tf, dl) of every chunk: how often the words follow each other, and how many words there are. words:
    corpus_words(chunks), if it is kept; the texts aren't read then."""
    words = corpus_words(chunks) if words is None else words
    joined = words.select("chunk_id", "dl", F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")).alias("line"))
    needle = f" {' '.join(phrase)} "
    # Occurrences may share words: each is matched without being consumed. The words hold no pattern characters.
    count = F.when(F.col("line").contains(needle), F.regexp_count("line", F.lit(f"(?={needle})"))).otherwise(0) if phrase else F.lit(0)
    return joined.select("chunk_id", count.alias("tf"), "dl")


def bm25(matches: DataFrame) -> DataFrame:
    """(chunk_id, rank) of the matching chunks, smaller being better; the phrase counts as one term. Counts and lengths
    of all chunks are written once, the statistics and the ranks both come from them."""
    matches = materialize(matches, "matches")
    stats = matches.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), F.sum((F.col("tf") > 0).cast("long")).alias("df")).first()
    n, avgdl, df = stats["n"] or 0, stats["avgdl"] or 1.0, stats["df"] or 0
    idf = F.log((F.lit(float(n - df)) + 0.5) / (F.lit(float(df)) + 0.5))
    idf = F.when(idf <= 0, F.lit(1e-6)).otherwise(idf)
    score = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(float(avgdl))))
    return matches.where("tf > 0").select("chunk_id", (-score).alias("rank"))


def numbered(words: DataFrame) -> DataFrame:
    """(chunk_id, rank_fts): places by (rank, chunk_id), without bringing all matches together.

    Only the distinct ranks, which are as many as there are pairs of term count and length, are summed up in one task;
    matches of equal rank are numbered by blocks of 65,536 ids.
    """
    words = materialize(words.withColumn("b", F.shiftright("chunk_id", 16)), "matches")
    blocks = words.groupBy("rank", "b").agg(F.count("*").alias("n"))
    ranks = blocks.groupBy("rank").agg(F.sum("n").alias("m"))
    ranks = ranks.select("rank", (F.sum("m").over(Window.orderBy("rank")) - F.col("m")).alias("above"))
    blocks = blocks.select("rank", "b", (F.sum("n").over(Window.partitionBy("rank").orderBy("b")) - F.col("n")).alias("earlier"))
    own = F.row_number().over(Window.partitionBy("rank", "b").orderBy("chunk_id"))
    return words.join(blocks, ["rank", "b"]).join(ranks, "rank").select("chunk_id", (F.col("above") + F.col("earlier") + own).alias("rank_fts"))


def reciprocal_ranks(near: DataFrame, words: DataFrame) -> DataFrame:
    """(chunk_id, combined_score): candidates of either list. near holds at most k rows, so one task numbers them."""
    a = near.select("chunk_id", F.row_number().over(Window.orderBy("distance", "chunk_id")).alias("rank_vec"))
    b = numbered(words)
    part = lambda c: F.coalesce(F.lit(1.0) / (RRF + F.col(c)), F.lit(0.0))
    return a.join(b, "chunk_id", "full").select("chunk_id", F.round(part("rank_vec") + part("rank_fts"), 9).alias("combined_score"))


def hybrid_search(vectors: DataFrame, chunks: DataFrame, files: DataFrame, query: list[float], dim: int, phrase: list[str], k: int = K, words: DataFrame | None = None) -> DataFrame:
    """Chunks near the query or holding the phrase, by reciprocal ranks, with every file that holds them, the best first."""
    fused = reciprocal_ranks(knn(vectors, query, dim, k), bm25(phrase_matches(chunks, phrase, words)))
    return _ordered(with_files(fused, chunks, files))


def phrases_of(queries: DataFrame, text: str = "query_text") -> DataFrame:
    """(query_id, phrase): the words of each query; quotes mean nothing, and a query without words matches nothing."""
    words = T.tokens(F.replace(F.col(text), F.lit('"'), F.lit("")))
    return queries.where(F.col("query_id").isNotNull()).select(F.col("query_id").cast("long").alias("query_id"), words.alias("phrase")).where(F.size("phrase") > 0).distinct()


def keyword_batch(words: DataFrame, phrases: DataFrame) -> DataFrame:
    """(query_id, chunk_id, rank) of all chunks of corpus_words() that hold a query's phrase, smaller being better.

    Each phrase is sought at the occurrences of its rarest word only: those places are joined with the queries, and the
    words around them compared.
    """
    small = (lambda d: F.broadcast(d)) if phrases.count() <= BROADCAST_ROWS // 8 else (lambda d: d)
    spots = words.select("chunk_id", F.posexplode("words").alias("pos", "term"))
    terms = phrases.select("query_id", "phrase", F.posexplode("phrase").alias("offset", "term"))
    counts = materialize(spots.join(small(terms.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n")), "terms")
    rarest = terms.join(counts, "term", "left").groupBy("query_id", "phrase").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "term")).alias("a"))
    anchors = rarest.where("a.n > 0").select("query_id", "phrase", F.col("a.offset").alias("offset"), F.col("a.term").alias("term"))
    places = spots.join(small(anchors), "term").select("query_id", "chunk_id", "phrase", (F.col("pos") - F.col("offset")).alias("at")).where("at >= 0")
    held = words.select(F.col("chunk_id").alias("chunk_id"), "dl", "words")
    there = places.join(held, "chunk_id").where(F.slice("words", F.col("at") + 1, F.size("phrase")) == F.col("phrase"))
    hits = materialize(there.groupBy("query_id", "chunk_id").agg(F.count("*").alias("tf"), F.min("dl").alias("dl")), "hits")
    n, avgdl = words.agg(F.count("*"), F.avg("dl")).first()
    df = hits.groupBy("query_id").agg(F.count("*").alias("df"))
    idf = F.log((F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(idf <= 0, F.lit(1e-6)).otherwise(idf)
    score = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(float(avgdl or 1.0))))
    return hits.join(df, "query_id").select("query_id", "chunk_id", (-score).alias("rank"))


def search_batch(vectors: DataFrame, chunks: DataFrame, files: DataFrame, queries: DataFrame, dim: int, k: int = K, cutoff: float = CUTOFF, words: DataFrame | None = None) -> DataFrame:
    """Results (query_id, chunk_id, file_name, file_path, content, combined_score) of a table of queries (query_id,
    query_text, embedding, hybrid); null hybrid counts as true. Blank texts find nothing. words: corpus_words(chunks),
    if it is kept."""
    asked = materialize(queries.where(F.length(T.trim(F.col("query_text"))) > 0).select(F.col("query_id").cast("long").alias("query_id"), "query_text", "embedding", F.coalesce("hybrid", F.lit(True)).alias("hybrid")), "asked")
    kinds = asked.select("query_id", "hybrid")
    near = materialize(knn_batch(vectors, asked, dim, k), "near")
    ranked = near.withColumn("rank_vec", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "chunk_id")))
    close = ranked.join(kinds.where("not hybrid"), "query_id", "left_semi").where(F.col("distance") <= cutoff).select("query_id", "chunk_id", F.round(1 - F.col("distance"), 6).alias("combined_score"))
    mixed = kinds.where("hybrid")
    words = materialize(corpus_words(chunks), "words") if words is None else words
    said = keyword_batch(words, phrases_of(asked.join(mixed, "query_id", "left_semi")))
    said = said.withColumn("rank_fts", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "chunk_id")))
    part = lambda c: F.coalesce(F.lit(1.0) / (RRF + F.col(c)), F.lit(0.0))
    fused = ranked.join(mixed, "query_id", "left_semi").join(said, ["query_id", "chunk_id"], "full")
    fused = fused.select("query_id", "chunk_id", F.round(part("rank_vec") + part("rank_fts"), 9).alias("combined_score"))
    return with_files(fused.unionByName(close), chunks, files).select("query_id", *RESULT)


def search(vectors: DataFrame, chunks: DataFrame, files: DataFrame, text: str | None, hybrid: bool = True, embedder: Embedder = hashing, dim: int = DIM, words: DataFrame | None = None) -> DataFrame:
    """(file_path, file_name) of the files found for a text, each once, the best first. A blank text finds nothing."""
    text = re.sub(f"^{T.SPACE_PATTERN}+|{T.SPACE_PATTERN}+$", "", text or "")
    if not text:
        return files.select(F.col("path").alias("file_path"), "file_name").limit(0)
    query = [float(x) for x in embedder([text])[0]]
    if not hybrid:
        return best_files(semantic_search(vectors, chunks, files, query, dim))
    row = files.sparkSession.createDataFrame([(0, text)], "query_id long, query_text string")
    phrase = phrases_of(row).first()
    return best_files(hybrid_search(vectors, chunks, files, query, dim, phrase["phrase"] if phrase else [], words=words))


def best_files(results: DataFrame) -> DataFrame:
    """(file_path, file_name): each file once, by its best chunk."""
    best = Window.partitionBy("file_path").orderBy(F.desc("combined_score"), "chunk_id")
    one = results.withColumn("k", F.row_number().over(best)).where("k = 1")
    return one.orderBy(F.desc("combined_score"), "chunk_id", "file_path").select("file_path", "file_name")
