"""Retrieval: vectors, BM25, their fusion, and search that follows the graph."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import QueryError
from ..functions.arrow import series_udf
from .traverse import DECAY, traverse

K1, B = 1.2, 0.75


def cosine(column: str, vector: list[float]) -> Column:
    """Cosine of an array column and a constant vector; null where it has none."""
    norm = sum(x * x for x in vector) ** 0.5
    const = F.array(*[F.lit(float(x)) for x in vector])
    x = F.transform(column, lambda e: e.cast("double"))
    dot = F.reduce(F.zip_with(x, const, lambda a, b: a * b), F.lit(0.0), lambda s, e: s + e)
    own = F.sqrt(F.reduce(x, F.lit(0.0), lambda s, e: s + e * e))
    fine = (F.size(x) == len(vector)) & (own > 0) & F.lit(norm > 0)
    return F.when(fine, dot / (own * F.lit(norm or 1.0)))


def vector_search(docs: DataFrame, vector: list[float], limit: int = 10, threshold: float | None = None, model_name: str | None = None, column: str = "embedding") -> DataFrame:
    """The ``limit`` documents most like ``vector``, with ``_score``; ties by key.
    Scores are exact. Threshold and model apply before the cut."""
    if column not in docs.columns:
        return docs.limit(0).withColumn("_score", F.lit(None).cast("double"))
    if model_name is not None:
        docs = docs.filter(F.col("model_name") == model_name)
    hits = docs.withColumn("_score", cosine(column, vector)).filter("_score is not null and not isnan(_score)")
    if threshold is not None:
        hits = hits.filter(F.col("_score") >= threshold)
    return hits.orderBy(F.desc("_score"), "_key").limit(limit)


def quantised(docs: DataFrame, column: str = "embedding") -> DataFrame:
    """``docs`` with ``_q`` (components scaled to -127..127) and ``_scale``, to store
    for the two-stage search."""
    scale = F.array_max(F.transform(column, lambda e: F.abs(e.cast("double")))) / 127
    docs = docs.withColumn("_scale", scale)
    return docs.withColumn("_q", F.transform(column, lambda e: F.round(F.try_divide(e.cast("double"), F.col("_scale"))).cast("tinyint")))


def two_stage_search(docs: DataFrame, vector: list[float], limit: int = 10, threshold: float | None = None, column: str = "embedding") -> DataFrame:
    """Search of :func:`quantised` documents: a scan of the small column keeps
    ``max(4 * limit, 32)``, which are ranked exactly."""
    rough = docs.withColumn("_rough", cosine("_q", vector)).orderBy(F.desc("_rough"), "_key").limit(max(4 * limit, 32))
    return vector_search(rough.drop("_rough", "_q", "_scale"), vector, limit, threshold, column=column)


def tokens(text: str) -> list[str]:
    """Lower-case runs of letters and digits."""
    out, run = [], ""
    for c in text.lower():
        if c.isalnum():
            run += c
        elif run:
            out.append(run)
            run = ""
    return [*out, run] if run else out


def check_fields(fields: list[str]) -> list[str]:
    if not fields or len(set(fields)) < len(fields) or any(not f or f.startswith("-") or f == "_key" for f in fields):
        raise QueryError(f"can't search in {fields}")
    return fields


def token_column(field: str) -> Column:
    """The same runs, as an array column."""
    return F.filter(F.split(F.lower(F.col(field)), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def text_search(docs: DataFrame, query: str, fields: list[str] | None = None, limit: int = 10, keep: list[str] | None = None) -> DataFrame:
    """The ``limit`` (1,000 at most) documents that match any word in any field, by
    BM25 summed over fields; ties by key. Only words of the query leave the scan;
    document counts and lengths come from one pass for each field. ``keep``: columns
    to return besides key and score."""
    fields = check_fields(fields or [f for f in ("content", "title") if f in docs.columns])
    limit = min(limit, 1000)
    words = tokens(query)
    texts = dict(docs.dtypes)
    legs = []
    for f in fields:
        if texts.get(f) != "string" or not words:
            continue
        listed = docs.filter(F.col(f).isNotNull()).select("_key", token_column(f).alias("t"))
        wanted = F.array(*map(F.lit, sorted(set(words))))
        # only texts that hold a word anywhere are split for scoring
        some = docs.filter(F.lower(f).rlike("|".join(sorted(set(words)))))
        hits = some.select("_key", token_column(f).alias("t")).select("_key", F.size("t").alias("n"), F.explode(F.filter("t", lambda t: F.array_contains(wanted, t))).alias("w"))
        tf = hits.groupBy("_key", "w").agg(F.count(F.lit(1)).alias("tf"), F.first("n").alias("n"))
        stats = listed.agg(F.count(F.lit(1)).alias("docs"), F.avg(F.size("t")).alias("mean"))
        df = tf.groupBy("w").agg(F.count(F.lit(1)).alias("df"))  # a row for each word of the query
        idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n") / F.col("mean")))
        times = F.lit(0)
        for w in set(words):
            times = times + F.when(F.col("w") == w, words.count(w)).otherwise(0)
        legs.append(tf.join(F.broadcast(df), "w").crossJoin(F.broadcast(stats)).select("_key", (part * times).alias("s")))
    if not legs:
        return docs.limit(0).select("_key", F.lit(0.0).alias("_score"), *(keep or []))
    every = legs[0]
    for leg in legs[1:]:
        every = every.unionByName(leg)
    top = every.groupBy("_key").agg(F.sum("s").alias("_score")).orderBy(F.desc("_score"), "_key").limit(limit)
    # at most 1,000 rows are left, whatever the corpus
    return top if keep is None else docs.select("_key", *keep).join(F.broadcast(top), "_key").orderBy(F.desc("_score"), "_key")


def normalise_query(text: Column | str) -> Column:
    """Trimmed, lower case, white space collapsed."""
    c = F.col(text) if isinstance(text, str) else text
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def parent(docs: DataFrame) -> Column:
    """A chunk's document, or the hit itself."""
    return F.coalesce("document_id", "_id") if "document_id" in docs.columns else F.col("_id")


def fuse(legs: list[tuple[DataFrame, float]], limit: int = 10, k: int = 60) -> DataFrame:
    """``id, score``: reciprocal ranks of several legs (``id``, ``_score``), each
    hit adding weight / (k + rank + 1). Legs are short, so one task ranks a leg."""
    out = None
    for leg, weight in legs:
        rank = F.row_number().over(Window.orderBy(F.desc("_score"), "id")) - 1
        part = leg.select("id", (F.lit(weight) / (k + rank + 1)).alias("s"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("id").agg(F.sum("s").alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def hybrid_search(docs: DataFrame, chunks: DataFrame, query: str, vector: list[float], fields: list[str] | None = None, limit: int = 10, k: int = 60, text_weight: float = 0.5, vector_weight: float = 0.5, threshold: float | None = 0.7, model_name: str | None = None, side_views: DataFrame | None = None) -> DataFrame:
    """BM25 over ``docs`` and vectors over ``chunks``, fused by reciprocal rank. A
    document with several chunks among the hits gains from each."""
    words = text_search(docs, query, fields, 3 * limit, keep=["_id"]).select(F.col("_id").alias("id"), "_score")
    near = vector_search(chunks, vector, 3 * limit, threshold, model_name)
    legs = [(words, text_weight), (near.select(parent(near).alias("id"), "_score"), vector_weight)]
    if side_views is not None:
        side = vector_search(side_views, vector, 3 * limit, threshold, model_name)
        legs.append((side.select(parent(side).alias("id"), "_score"), vector_weight))
    return fuse(legs, limit, k)


def semantic_search(chunks: DataFrame, query: str, embed: Callable[[str], list[float]], limit: int = 10, threshold: float | None = 0.7, model_name: str | None = None) -> DataFrame:
    """``id, score``: a query's text, embedded by ``embed``, to parent documents; a
    document's best chunk counts."""
    hits = vector_search(chunks, embed(query), limit, threshold, model_name)
    return hits.groupBy(parent(hits).alias("id")).agg(F.max("_score").alias("score")).orderBy(F.desc("score"), "id")


def graph_augmented_search(docs: DataFrame, edges: DataFrame, vector: list[float], seeds: int = 5, depth: int = 2, direction: str = "OUTBOUND", decay: float = DECAY, threshold: float | None = 0.7, model_name: str | None = None, limit: int | None = None) -> DataFrame:
    """``id, score, source, depth``: vector seeds, and what they reach within
    ``depth``, scored by seed and path. The first to reach a vertex counts: better
    seeds before others, shorter paths before longer."""
    hits = vector_search(docs, vector, seeds, threshold, model_name)
    rank = F.row_number().over(Window.orderBy(F.desc("_score"), "_key"))  # at most `seeds` rows
    hits = hits.select(F.col("_id").alias("start"), F.col("_score").alias("seed_score"), rank.alias("seed"))
    paths = traverse(edges, hits.select("start"), 1, depth, direction, decay=decay, edge_fields=set())
    reached = paths.join(F.broadcast(hits), "start").select("id", (F.col("score") * F.col("seed_score")).alias("score"), F.lit("graph").alias("source"), "depth", "seed", "ids")
    own = hits.select(F.col("start").alias("id"), F.col("seed_score").alias("score"), F.lit("vector").alias("source"), F.lit(0).alias("depth"), F.lit(0).alias("seed"), F.array("start").alias("ids"))
    first = Window.partitionBy("id").orderBy("seed", "depth", "ids")
    out = own.unionByName(reached).withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    out = out.select("id", "score", "source", "depth").orderBy(F.desc("score"), "id")
    return out.limit(limit) if limit else out


def cache_weight(similarity: Column, rank: Column, floor: float = 0.7) -> Column:
    """Weight of a remembered result: cubic above the floor, falling with rank."""
    above = F.greatest((similarity - floor) / (1 - floor), F.lit(0.0))
    return F.pow(above, 3) / (1 + 0.15 * rank)


def embedded(docs: DataFrame, embed: Callable[[list[str]], list[list[float]]], text: str = "content", batch: int = 64, model_name: str | None = None) -> DataFrame:
    """``docs`` with ``embedding``: ``embed`` gets ``batch`` texts at a time."""

    def run(texts):
        values = [t or "" for t in texts]
        out: list = []
        for i in range(0, len(values), batch):
            out += [list(map(float, v)) for v in embed(values[i : i + batch])]
        return type(texts)(out)

    out = docs.withColumn("embedding", series_udf(run, "array<double>")(text))
    return out if model_name is None else out.withColumn("model_name", F.lit(model_name))
