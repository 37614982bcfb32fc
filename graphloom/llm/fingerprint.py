"""Document fingerprints: threshold-scaled sketches, in DataFrame functions only.

A sketch keeps every hash of a text's shingles (five words) that lies below a
fixed fraction of the hash range, and always the least one, so that no text with
words has an empty sketch. Unlike a sketch of fixed size, it grows with the
text: the sketch of a union is the union of sketches, and containment between
very unequal documents stays an unbiased share of kept hashes.

A text with fewer words is one shingle; one without words has an empty sketch,
which is like another empty one (1) and unlike any other (0). Null text is
empty. A null doc_id comes first in the order; rows with equal doc_id are ordered
by a hash of their text. A sole document is its own next one. An empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, texts

NULL = -(2**63)
FRACTION = 4  # one hash in so many is kept


def let(value: Column, body) -> Column:
    """``body(value)``, with the value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sketch(text: Column, size: int = 5, fraction: int = FRACTION) -> Column:
    """Kept shingle hashes of a text, ascending."""
    limit = NULL + 2**64 // fraction

    def of_words(words: Column) -> Column:
        last = F.greatest(F.size(words) - size, F.lit(0))
        hashes = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)]))
        kept = let(hashes, lambda h: F.array_sort(F.array_distinct(F.concat(F.filter(h, lambda x: x < F.lit(limit)), F.array(F.array_min(h))))))
        return F.when(F.size(words) > 0, kept).otherwise(F.array().cast("array<bigint>"))

    return let(F.filter(F.split(text, "[ \\t-\\r]+"), lambda w: w != ""), of_words)


def merge(a: Column, b: Column) -> Column:
    """The sketch of both texts' shingles together."""
    return F.array_sort(F.array_union(a, b))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two texts' shingles."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of ``a``'s shingles that are in ``b``."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def as_text(kept: Column) -> Column:
    """A sketch as a string: 16 lower-case hex digits for each hash, in order."""
    return F.array_join(F.transform(kept, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def fingerprints(docs: DataFrame, size: int = 5, fraction: int = FRACTION) -> DataFrame:
    """``doc_id, fingerprint`` of each document."""
    return texts(docs).select("doc_id", sketch(F.col("text"), size, fraction).alias("fingerprint"))


def with_next(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """``doc_id, text, next_text, fingerprint, next_fingerprint``: each document and
    the one after it by doc_id; after the last comes the first.

    Documents are dealt into ranges of doc_id, so no task sees more than one
    range, and the first document of a range is also sent to the range before it.
    The driver gets a doc_id for each range."""
    ranges = ranges or 4 * partitions(docs.sparkSession)
    docs = texts(docs).select(F.coalesce("doc_id", F.lit(NULL)).alias("doc_id"), "text")
    share = [i / ranges for i in range(1, ranges)]
    cuts = docs.agg(F.percentile_approx("doc_id", F.array(*map(F.lit, share)), F.lit(ranges * 20)).alias("c")).first().c or []

    def place(bounds: list[int]) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("doc_id")))

    cuts = sorted(set(cuts))
    least = docs.select("doc_id", (place(cuts) if cuts else F.lit(0)).alias("r")).groupBy("r").agg(F.min("doc_id").alias("first")).collect()
    firsts = sorted(r["first"] for r in least) or [0]
    own = place(firsts) - 1
    before = F.pmod(own - 1, F.lit(len(firsts)))
    is_first = F.get(F.array(*map(F.lit, firsts)), own) == F.col("doc_id")
    here = F.struct(own.alias("range"), F.lit(0).alias("guest"))
    there = F.struct(before.alias("range"), F.lit(1).alias("guest"))
    docs = docs.select("doc_id", "text", F.explode(F.when(is_first, F.array(here, there)).otherwise(F.array(here))).alias("p"))
    docs = docs.select("doc_id", "text", "p.range", "p.guest", F.xxhash64("text").alias("h"))
    order = Window.partitionBy("range").orderBy("guest", "doc_id", "h")
    docs = docs.withColumn("next_text", F.lead("text").over(order))
    docs = docs.withColumn("fingerprint", sketch(F.col("text")))
    docs = docs.withColumn("next_fingerprint", F.lead("fingerprint").over(order))
    return docs.filter("guest = 0").select(F.nullif(F.col("doc_id"), F.lit(NULL)).alias("doc_id"), "text", "next_text", "fingerprint", "next_fingerprint")


def compare_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of the text with its last quarter replaced
    by the beginning of the next document, and how alike they are."""
    n, k = F.length("text"), F.floor(F.length("text") / 4).cast("int")
    each = with_next(docs).withColumn("edited", F.concat(F.substring("text", F.lit(1), n - k), F.substring("next_text", F.lit(1), k)))
    each = each.withColumn("edited_fingerprint", sketch(F.col("edited")))
    return each.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("fingerprint")).alias("fingerprint"),
        as_text(F.col("edited_fingerprint")).alias("edited_fingerprint"),
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
