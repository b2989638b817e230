"""Lexical search over documents: postings, BM25, rank fusion; many queries at once, never a loop over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelode.functions.text import bounded_terms, tokens

K1, B = 1.2, 0.75


def postings(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, term, tf, length: one row per document and term."""
    terms = docs.select(F.col(doc).alias("doc"), tokens(F.coalesce(F.col(text), F.lit(""))).alias("terms")).withColumn("length", F.size("terms"))
    return terms.select("doc", "length", F.explode("terms").alias("term")).groupBy("doc", "length", "term").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, queries: DataFrame, k: int = 10, filters: DataFrame | None = None, doc: str = "doc_id") -> DataFrame:
    """query_id, doc, score, rank: the best k documents of each query.

    Statistics cover all documents; `filters` (doc) keeps documents after that. The queries' terms are few: they
    are joined first, so only postings of asked terms are shuffled.
    """
    q = queries.select("query_id", F.posexplode(bounded_terms(tokens(F.col("text")))).alias("at", "term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"), F.min("at").alias("first_at"))
    size = docs.select(F.size(tokens(F.coalesce(F.col("text"), F.lit("")))).alias("n")).agg(F.count("*").alias("N"), F.greatest(F.avg("n"), F.lit(1.0)).alias("avgdl"))
    asked = postings(docs, doc).join(q.select("term").distinct(), "term", "left_semi")
    df = asked.groupBy("term").agg(F.count("*").alias("df"))
    hits = asked.join(q, "term")
    if filters is not None:
        hits = hits.join(filters.select("doc"), "doc", "left_semi")
    idf = F.log(1 + (F.col("N") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("avgdl")))
    scored = hits.join(df, "term").join(F.broadcast(size)).groupBy("query_id", "doc").agg(F.sum(idf * weight * F.col("qtf")).alias("score"), F.min("first_at").alias("first_at"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "first_at", "doc"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "doc", "score", "rank")


def fuse(first: DataFrame, second: DataFrame, weights: tuple[float, float] = (1.25, 1.0), k: int = 10, offset: int = 60) -> DataFrame:
    """Weighted reciprocal-rank fusion of two ranked lists (query_id, doc, rank from 1): query_id, doc, score, rank."""
    if not all(0 < w < float("inf") for w in weights):
        raise ValueError("weights must be positive and finite")
    lists = [df.select("query_id", "doc", F.lit(w).alias("w"), F.col("rank").alias("r"), F.lit(i).alias("list")) for i, (df, w) in enumerate(zip((first, second), weights))]
    both = lists[0].unionByName(lists[1]).groupBy("query_id", "doc").agg(F.sum(F.col("w") / (offset + F.col("r"))).alias("score"), F.min(F.when(F.col("list") == 0, F.col("r"))).alias("r1"), F.min(F.when(F.col("list") == 1, F.col("r"))).alias("r2"))
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), F.asc_nulls_last("r1"), F.asc_nulls_last("r2"), "doc")
    return both.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "doc", "score", "rank")


def build_documents(events: DataFrame) -> DataFrame:
    """doc_id, event_id, kind, text of each event: its base text, its error signatures and its file paths, by explode."""
    from tracelode.functions.text import error_signatures, file_paths

    text = F.trim(F.regexp_replace(F.concat_ws(" ", "type", "command", "output"), r"[ \t\n\r\f]+", " "))
    clipped = F.when(F.length(text) > 6000, F.concat(F.substring(text, 1, 6000), F.lit("\n...[truncated]"))).otherwise(text)
    part = lambda kind, items: F.transform(items, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("at"), x.alias("text")))
    parts = F.concat(F.array(F.struct(F.lit("base").alias("kind"), F.lit(0).alias("at"), clipped.alias("text"))), part("err", error_signatures(F.col("output"))), part("path", file_paths(F.col("output"))))
    exploded = events.select("id", F.explode(parts).alias("p"))
    doc_id = F.when(F.col("p.kind") == "base", F.concat("id", F.lit(":base"))).otherwise(F.concat_ws(":", "id", "p.kind", F.col("p.at").cast("string")))
    return exploded.select(doc_id.alias("doc_id"), F.col("id").alias("event_id"), F.col("p.kind").alias("kind"), F.col("p.text").alias("text"))
