"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents, in an order given by a hash of doc_id, form a stream
of words that is cut into blocks of ``block`` words.  Slot i of the schedule
stands at the golden-ratio point frac(i * F45 / F46) (a Fibonacci lattice, so
it is exact integer arithmetic); the cumulative targets map points to sources.
The slots of a source are ranked, and rank r takes its block r mod (number of
blocks): when all blocks are taken the source starts over.  Slots that would
take a source's blocks more than ``most`` times go, in the schedule's order, to
the sources that have room, one to each in turns.

Targets share all words by weight, but stop at ``most`` times the source's
words; what is above is shared again by weight until no source is above.

Cases: a null text has size 0; a null source is a source of its own, the last;
sources of no words get nothing; equal doc_ids are ordered by size and text;
repeated rows each have a place in the stream; an empty table gives no rows;
further columns are ignored.  Ranks and offsets are sums in two steps, over
buckets of bounded size, so no source has to fit one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import tables as T

WEIGHTS, MOST, BLOCK = (1, 2, 3), 3, 32
#: Neighbouring Fibonacci numbers; their ratio is the golden ratio's to 18 digits.
F45, F46 = 1134903170, 1836311903
BUCKET_DOCS, CHUNK_SLOTS, CELLS = 2_000, 65_536, 1024
WORD = "[^\\x20\\x09-\\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _order(doc_id: Column) -> Column:
    return F.md5(F.concat(F.lit("mix:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """For each source (row: source, source_size, docs): its place, weight, target and its share of the points [low, high).

    One row for each source; a table of sources is small, and is ordered as a whole."""
    every = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    placed = sizes.withColumn("place", F.row_number().over(every)).withColumn("weight", weight)
    limit = F.col("source_size") * most
    by_limit = Window.orderBy(limit / F.col("weight"), "place")
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    after = by_limit.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    total = F.sum("source_size").over(whole)
    level = (total - F.coalesce(F.sum(limit).over(before), F.lit(0))).cast("double") / F.sum("weight").over(after)
    levelled = placed.withColumn("total", total).withColumn("level", level).withColumn("over", limit > F.col("level") * F.col("weight"))
    levelled = levelled.withColumn("level", F.min(F.when(F.col("over"), F.struct(limit / F.col("weight"), "place", "level"))).over(whole)["level"])
    levelled = levelled.withColumn("target", F.when(F.col("level").isNull(), limit.cast("double")).otherwise(F.least(limit.cast("double"), F.col("level") * F.col("weight"))))
    up_to = Window.orderBy("place")
    high = F.sum("target").over(up_to.rowsBetween(Window.unboundedPreceding, 0))
    low = F.coalesce(F.sum("target").over(up_to.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    scale = F.lit(float(F46)) / F.col("total")
    return levelled.select(
        "source",
        "place",
        "source_size",
        "docs",
        "total",
        "target",
        F.when(F.col("total") > 0, F.ceil(low * scale)).otherwise(0).alias("low"),
        F.when(F.col("total") > 0, F.ceil(high * scale)).otherwise(0).alias("high"),
    )


def streams(documents: DataFrame, sources: DataFrame) -> DataFrame:
    """Documents with the first word's place in their source's stream."""
    ordered = documents.join(sources.select("source", "place", "source_size", "docs", "target").withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    ordered = ordered.withColumn("key", _order(F.col("doc_id")))
    buckets = F.greatest(F.lit(1), F.ceil(F.col("docs") / BUCKET_DOCS)).cast("long")
    ordered = ordered.withColumn("bucket", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * buckets / (1 << 32)).cast("long"))
    sums = ordered.groupBy("place", "bucket").agg(F.sum("size").alias("words"))
    offset = F.sum("words").over(Window.partitionBy("place").orderBy("bucket")) - F.col("words")
    offsets = sums.select(F.col("place").alias("p"), F.col("bucket").alias("b"), offset.alias("offset"))
    local = Window.partitionBy("place", "bucket").orderBy("key", "size", "text_hash").rowsBetween(Window.unboundedPreceding, 0)
    ordered = ordered.withColumn("local", F.sum("size").over(local) - F.col("size"))
    return ordered.join(offsets, (F.col("place") == F.col("p")) & (F.col("bucket") == F.col("b"))).withColumn("first", F.col("offset") + F.col("local")).drop("p", "b", "offset", "local", "bucket")


def handed_over(sources: list, most: int = MOST) -> list[tuple[int, int]]:
    """(place, rank) for each slot above its source's ``most`` epochs, in the schedule's order.

    The sources with room take such slots in turns, each its next rank, by their place.  sources: (place, blocks, slots)
    of each, of which there are few; so are the slots above."""
    left = sum(max(0, n - most * blocks) for _, blocks, n in sources)
    open_, out, turn = sorted((p, n, most * blocks - n) for p, blocks, n in sources if n < most * blocks), [], 0
    while len(out) < left:
        out += [(p, n + turn) for p, n, room in open_ if turn < room]
        turn += 1
    return out[:left]


def schedule(sources: DataFrame, slots: int, block: int = BLOCK, most: int = MOST) -> DataFrame:
    """slot, place (of the source), rank, block and epoch of every slot of the mix; no epoch is ``most`` or above."""
    spark = sources.sparkSession
    width = -(-F46 // CELLS)
    cells = sources.filter("high > low").select(
        "place", "low", "high", F.ceil(F.col("source_size") / block).alias("blocks"), F.explode(F.sequence(F.floor(F.col("low") / width), F.floor((F.col("high") - 1) / width))).alias("cell")
    )
    points = spark.range(slots).select(F.col("id").alias("slot"), ((F.col("id") % F46) * F45 % F46).alias("point"))
    points = points.withColumn("cell", F.floor(F.col("point") / width))
    dealt = points.join(cells, "cell").filter("point >= low and point < high").withColumn("chunk", F.floor(F.col("slot") / CHUNK_SLOTS))
    counts = T.written(dealt.groupBy("place", "chunk").agg(F.count("*").alias("n")))
    before = counts.select("place", "chunk", (F.sum("n").over(Window.partitionBy("place").orderBy("chunk")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("place", "chunk").orderBy("slot")) - 1
    ranked = dealt.withColumn("local", rank).join(before, ["place", "chunk"]).withColumn("rank", F.col("before") + F.col("local"))
    ranked = ranked.select("slot", "place", "rank", "blocks")
    each = sources.select("place", "low", "high", F.ceil(F.col("source_size") / block).alias("blocks")).join(counts.groupBy("place").agg(F.sum("n").alias("n")), "place", "left")
    moved = handed_over([(r["place"], r["blocks"], r["n"] or 0) for r in each.collect()], most)  # a row for each source
    if moved:
        above = ranked.filter(F.col("rank") >= most * F.col("blocks")).select("slot").withColumn("i", F.row_number().over(Window.orderBy("slot")) - 1)  # a few for each source
        to = spark.createDataFrame([(i, *x) for i, x in enumerate(moved)], "i int, place int, rank long").join(sources.select("place", F.ceil(F.col("source_size") / block).alias("blocks")), "place")
        ranked = ranked.filter(F.col("rank") < most * F.col("blocks")).unionByName(above.join(to, "i").drop("i"))
    return ranked.select("slot", "place", "rank", (F.col("rank") % F.col("blocks")).alias("block"), F.floor(F.col("rank") / F.col("blocks")).alias("epoch"))


def segments(placed: DataFrame, block: int = BLOCK) -> DataFrame:
    """The parts of documents in each block of their source: block, words."""
    last = F.col("first") + F.col("size") - 1
    cut = placed.filter("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("first") / block), F.floor(last / block))))
    words = F.least(F.col("first") + F.col("size"), (F.col("block") + 1) * block) - F.greatest(F.col("first"), F.col("block") * block)
    return cut.withColumn("words", words)


@T.tidy
def mixed(documents: DataFrame, weights=WEIGHTS, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """_row, doc_id, size, source_size, target, taken of each document; _row tells rows of equal doc_id apart.

    documents: doc_id, text, source."""
    sized = T.written(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash")).withColumn("_row", F.monotonically_increasing_id()))
    sources = T.written(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs")), weights, most))
    total = sources.agg(F.max("total")).first()[0] or 0
    placed = T.written(streams(sized, sources))
    uses = schedule(sources, -(-total // block), block, most).groupBy("place", "block").agg(F.count("*").alias("uses"))
    parts = segments(placed.select("_row", "place", "size", "first"), block).select("_row", "place", "block", "words")
    taken = parts.join(uses, ["place", "block"]).groupBy("_row").agg(F.sum(F.col("words") * F.col("uses")).alias("taken"))
    return placed.join(taken, "_row", "left").select("_row", "doc_id", "source", "size", "text_hash", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def first_words(text: Column, n: Column) -> Column:
    """A text up to and with its n-th word."""
    words = F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lit(1), n)
    gaps = F.slice(F.split(text, WORD, -1), F.lit(1), n)
    return F.array_join(F.zip_with(gaps, words, lambda g, w: F.concat(g, w)), "")


@T.tidy
def repeated(documents: DataFrame, **options) -> DataFrame:
    """Documents as often as the mix takes them: whole copies, and a copy of the first words for the rest.

    Rows equal in doc_id, source and text are taken together.  n_chars follows the text."""
    identity = ["_key", "_text", "_source"]
    marks = [T.doc_key().alias("_key"), F.xxhash64("text").alias("_text"), F.xxhash64("source").alias("_source")]
    taken = mixed(documents, **options).withColumn("_key", T.doc_key()).withColumn("_source", F.xxhash64("source"))
    taken = taken.groupBy("_key", F.col("text_hash").alias("_text"), "_source").agg(F.sum("taken").alias("taken"), F.max("size").alias("size")).filter("taken > 0")
    columns = documents.columns
    rows = documents.select(F.struct(*columns).alias("row"), *marks).join(taken, identity).groupBy(*identity, "taken", "size").agg(F.min("row").alias("row"))
    whole, rest = F.floor(F.col("taken") / F.col("size")), (F.col("taken") % F.col("size")).cast("int")
    copies = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), whole + (rest > 0).cast("long"))))
    text = F.when(F.col("copy") <= whole, F.col("row.text")).otherwise(first_words(F.col("row.text"), rest))
    copies = copies.select("row", text.alias("text"))
    return copies.select(*[F.col("text") if c == "text" else F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"row.`{c}`") for c in columns])


def op6_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mixed(T.read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = """
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source COLLATE C) AS place FROM s0),
s2 AS (SELECT *, (place - 1) % 3 + 1 AS weight, sum(source_size) OVER () AS total FROM s1),
s3 AS (SELECT *, CAST(total - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
              / sum(weight) OVER (ORDER BY 3 * source_size / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s2),
lv AS (SELECT arg_min(level, [3 * source_size / weight, place]) AS level FROM s3 WHERE 3 * source_size > level * weight),
s4 AS (SELECT source, place, source_size, total, CASE WHEN (SELECT level FROM lv) IS NULL THEN CAST(3 * source_size AS DOUBLE) ELSE least(CAST(3 * source_size AS DOUBLE), (SELECT level FROM lv) * weight) END AS target FROM s3),
s5 AS (SELECT *, CASE WHEN total > 0 THEN ceil(coalesce(sum(target) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * (1836311903.0::DOUBLE / total)) ELSE 0 END AS low,
              CASE WHEN total > 0 THEN ceil(sum(target) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) * (1836311903.0::DOUBLE / total)) ELSE 0 END AS high FROM s4),
slots AS (SELECT i, (i % 1836311903) * 1134903170 % 1836311903 AS point FROM (SELECT unnest(range(0, CAST((SELECT ceil(sum(size) / 32.0) FROM d) AS BIGINT))) AS i)),
ranked AS (SELECT s5.place, row_number() OVER (PARTITION BY s5.place ORDER BY i) - 1 AS r, CAST(ceil(source_size / 32.0) AS BIGINT) AS blocks FROM slots JOIN s5 ON point >= low AND point < high),
room AS (SELECT s4.place, CAST(ceil(source_size / 32.0) AS BIGINT) AS blocks, coalesce(n, 0) AS n FROM s4 LEFT JOIN (SELECT place, count(*) AS n FROM ranked GROUP BY place) c USING (place)),
above AS (SELECT CAST(coalesce(sum(greatest(0, n - 3 * blocks)), 0) AS BIGINT) AS k FROM room),
moved AS (SELECT place, n + turn AS r, blocks FROM (SELECT *, unnest(range(0, least(greatest(0, 3 * blocks - n), (SELECT k FROM above)))) AS turn FROM room) ORDER BY turn, place LIMIT (SELECT k FROM above)),
uses AS (SELECT place, r % blocks AS block, count(*) AS uses FROM (SELECT place, r, blocks FROM ranked WHERE r < 3 * blocks UNION ALL SELECT place, r, blocks FROM moved) GROUP BY ALL),
placed AS (SELECT doc_id, size, place, source_size, target, sum(size) OVER (PARTITION BY place ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS first
           FROM d JOIN s4 ON d.source IS NOT DISTINCT FROM s4.source),
parts AS (SELECT doc_id, place, size, first, unnest(range(CAST(first // 32 AS BIGINT), CAST((first + size - 1) // 32 AS BIGINT) + 1)) AS block FROM placed WHERE size > 0),
taken AS (SELECT doc_id, sum((least(first + size, (block + 1) * 32) - greatest(first, block * 32)) * uses) AS taken FROM parts JOIN uses USING (place, block) GROUP BY doc_id)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM placed LEFT JOIN taken USING (doc_id)
"""
