"""Document fingerprints with SQL functions alone: a threshold-scaled sketch.

A document's shingles are its runs of five words (with fewer words, all of them
as one).  Of their 64-bit hashes, the sketch keeps each that lies below a fixed
fraction of the range; where none does, the least one stands alone, as the mark of
a text too short for the fraction.  The sketch of two documents together follows
from their sketches by the same rule: the hashes below the fraction, or the least.
So the sketch grows with the document, and likeness and containment are estimated
from sketches alone, also between documents of very different sizes.

Cases: a null text is empty; a text without words has an empty sketch, which is
like another empty one (1.0) and unlike all others (0.0); a null doc_id is the
largest; equal doc_ids are ordered by a hash of the text; an empty table gives no
rows; a single document is its own next; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import ranges
from . import tables as T

SHINGLE, FRACTION = 5, 0.25
BUCKET_BYTES, MOST_BUCKETS = 4_000_000, 50_000


def shingle_hashes(text: Column, shingle: int = SHINGLE) -> Column:
    words = F.filter(F.split(F.lower(text), "[\\x20\\x09-\\x0D]+", -1), lambda w: w != "")
    hashed = F.transform(words, lambda w: F.xxhash64(w))

    def runs(h: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(h) - shingle)
        return F.when(F.size(h) >= shingle, F.transform(at, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(shingle)]))).otherwise(
            F.when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.expr("cast(array() as array<bigint>)"))
        )

    return F.element_at(F.transform(F.array(hashed), runs), 1)


def _limit(fraction: float) -> int:
    return int(-(2**63) + fraction * 2**64)


def _kept(hashes: Column, fraction: float) -> Column:
    """Of distinct hashes those below the threshold, or the least of all."""
    low = F.filter(hashes, lambda x: x < F.lit(_limit(fraction)))
    return F.element_at(F.transform(F.array(low), lambda x: F.when(F.size(x) > 0, x).when(F.size(hashes) > 0, F.array(F.array_min(hashes))).otherwise(hashes)), 1)


def sketch(text: Column, fraction: float = FRACTION, shingle: int = SHINGLE) -> Column:
    """Sorted distinct hashes below the threshold, or the least hash."""
    return F.element_at(F.transform(F.array(shingle_hashes(text, shingle)), lambda h: F.array_sort(F.array_distinct(_kept(h, fraction)))), 1)


def merged(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """The sketch of both documents."""
    return F.element_at(F.transform(F.array(F.array_union(a, b)), lambda h: F.array_sort(_kept(h, fraction))), 1)


def likeness(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """Estimated share of common shingles among all of both: of the hashes in the sketch of both, those in each."""
    share = lambda m: F.size(F.array_intersect(m, F.array_intersect(a, b))) / F.size(m)
    return F.element_at(F.transform(F.array(merged(a, b, fraction)), lambda m: F.when(F.size(m) == 0, F.lit(1.0)).otherwise(share(m))), 1)


def containment(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """Estimated share of a's shingles that b has; null where a's hash lies above the threshold and b does not tell."""
    short = F.get(a, F.lit(0)) >= F.lit(_limit(fraction))
    found = F.size(F.array_intersect(a, b)) / F.size(a)
    return F.when(F.size(a) == 0, F.lit(1.0)).when(short & (found == 0), F.when(F.size(b) == 0, F.lit(0.0))).otherwise(found)


def spelled(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def with_next(documents: DataFrame) -> tuple[DataFrame, Window]:
    """Each document with the next one's text, by descending doc_id; after the last comes the first.

    Documents are dealt to ranges of their order, about ``BUCKET_BYTES`` of text each; each range also gets the first
    document of the range that follows.  A doc_id that would fill several ranges is cut by the texts' hashes."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), T.doc_key().alias("_key"), F.coalesce("text", F.lit("")).alias("text")).withColumn("_tie", F.xxhash64("text"))
    docs = ranges.ranged(docs, "_key", F.col("_tie"), F.octet_length("text") + 200, BUCKET_BYTES, MOST_BUCKETS)
    first = F.max(F.struct("_key", "_tie")).alias("head")
    heads = sorted(((r["_range"], r["head"]["_key"], r["head"]["_tie"]) for r in docs.groupBy("_range").agg(first).collect()), reverse=True)  # one for each range
    lead = Window.partitionBy("_range").orderBy(F.col("_guest"), F.col("_key").desc(), F.col("_tie").desc(), "text")
    whole = docs.withColumn("_guest", F.lit(False))
    if heads:
        to = ", ".join(f"({key}L, {tie}L, {heads[i - 1][0]}L)" for i, (_, key, tie) in enumerate(heads))
        target = F.broadcast(docs.sparkSession.sql(f"SELECT * FROM VALUES {to} AS t(_key, _tie, _range)"))  # one row for each range
        guests = docs.drop("_range").join(target, ["_key", "_tie"]).groupBy("doc_id", "_key", "_tie", "_range").agg(F.min("text").alias("text"))
        whole = whole.unionByName(guests.select("doc_id", "_key", "text", "_tie", "_range", F.lit(True).alias("_guest")))
    return whole.withColumn("next_text", F.lead("text").over(lead)), lead


def op8_fingerprints(spark, sf_dir: str) -> DataFrame:
    docs, lead = with_next(T.read(spark, sf_dir, "documents"))
    docs = docs.withColumn("sketch", sketch(F.col("text")))
    docs = docs.withColumn("next_sketch", F.lead("sketch").over(lead)).filter("not _guest")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    docs = docs.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "sketch", "next_sketch")
    docs = docs.withColumn("edited_sketch", sketch(F.col("edited")))
    return docs.select(
        "doc_id",
        "n_chars",
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        spelled(F.col("sketch")).alias("fingerprint"),
        spelled(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
