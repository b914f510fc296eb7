"""Token streams: prefix sums over all documents, shards, frames, next-fit packing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranges


def offsets(docs: DataFrame, size: Column, key: str = "doc_id", bucket: int = ranges.ROWS) -> DataFrame:
    """start: the sum of all sizes before each row, by key (a long; null last), then by a hash of the row."""
    marked = docs.withColumn("_key", F.coalesce(F.col(key).cast("long"), F.lit((1 << 63) - 1))).withColumn("_tie", F.xxhash64(*docs.columns))
    return ranges.running(ranges.ranged(marked, "_key", F.col("_tie"), each=bucket), size, ["_key", "_tie"]).drop("_key", "_tie")


def shard_counts(placed: DataFrame, size: Column, shard: int) -> DataFrame:
    """Tokens of each shard of ``shard`` tokens. placed: start."""
    spans = placed.withColumn("_n", size.cast("long")).filter("_n > 0")
    spans = spans.withColumn("shard", F.explode(F.sequence(F.floor(F.col("start") / shard), F.floor((F.col("start") + F.col("_n") - 1) / shard))))
    inside = F.least(F.col("start") + F.col("_n"), (F.col("shard") + 1) * shard) - F.greatest(F.col("start"), F.col("shard") * shard)
    return spans.groupBy("shard").agg(F.sum(inside).alias("tokens"))


def shards(docs: DataFrame, shard: int, end_id: int, key: str = "doc_id") -> DataFrame:
    """shard, tokens: the documents' ids in order of key, each ended, cut every ``shard`` tokens; the last is shorter. docs: key, ids."""
    ended = docs.select(key, F.concat("ids", F.array(F.lit(end_id))).alias("ids"))
    placed = offsets(ended, F.size("ids"), key)
    first, last = F.floor(F.col("start") / shard), F.floor((F.col("start") + F.size("ids") - 1) / shard)
    cut = placed.withColumn("shard", F.explode(F.sequence(first, last)))
    low = F.greatest(F.lit(0), F.col("shard") * shard - F.col("start")).cast("int")
    high = F.least(F.size("ids"), (F.col("shard") + 1) * shard - F.col("start")).cast("int")
    cut = cut.select("shard", "start", F.slice("ids", low + 1, high - low).alias("ids"))
    whole = F.array_sort(F.collect_list(F.struct("start", "ids")))  # a shard has a fixed number of tokens
    return cut.groupBy("shard").agg(F.flatten(F.transform(whole, lambda x: x["ids"])).alias("tokens"))


def next_fit(sizes: list[int], room: int) -> list[int]:
    """The sequence each example goes to: the present one if it fits, else the next; -1 for those that never fit."""
    out, at, free = [], 0, room
    for n in sizes:
        if n > room:
            out.append(-1)
        else:
            if n > free:
                at, free = at + 1, room
            out.append(at)
            free -= n
    return out


def parts_for(examples: DataFrame, each: int = 100_000) -> int:
    """Groups of next-fit packing: one for so many examples, eight at least."""
    return max(8, -(-examples.count() // each))


def packed(examples: DataFrame, room: int, seed: int = 0, parts: int | None = None, key: str = "id", size: str = "size") -> DataFrame:
    """part, sequence, segment of each example: dealt to parts in a seeded order, next fit within a part.

    Every part is folded in order from sorted batches, so memory follows the batch; an example that exceeds the room has
    sequence -1.  Sequences of a part ascend from 0."""
    parts = parts or parts_for(examples)
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    dealt = examples.select(F.col(key).alias("id"), F.col(size).cast("int").alias("size"), order.alias("o")).withColumn("part", (F.conv(F.substring("o", 1, 8), 16, 10).cast("long") % parts).cast("int"))
    dealt = dealt.repartition("part").sortWithinPartitions("part", "o", "id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, at, free, inside, lost = None, 0, room, 0, 0
        for x in batches:
            sequence, segment = [], []
            for part, n in zip(x["part"].tolist(), x["size"].tolist(), strict=True):
                if part != now:
                    now, at, free, inside, lost = part, 0, room, 0, 0
                if n > room:
                    sequence.append(-1)
                    segment.append(lost)
                    lost += 1
                    continue
                if n > free:
                    at, free, inside = at + 1, room, 0
                sequence.append(at)
                segment.append(inside)
                free, inside = free - n, inside + 1
            yield x.assign(sequence=sequence, segment=segment)[["id", "size", "part", "sequence", "segment"]]

    return dealt.mapInPandas(run, f"id {dict(examples.dtypes)[key]}, size int, part int, sequence int, segment int")


def steps(found: DataFrame, batch: int) -> DataFrame:
    """examples, sequences, mean_packed, steps: how many batches an epoch of packed examples has. found: of ``packed``."""
    used = found.filter("sequence >= 0").agg(F.count("*").alias("examples"), F.countDistinct("part", "sequence").alias("sequences"))
    mean = F.col("examples") / F.greatest(F.lit(1), F.col("sequences"))
    return used.withColumn("mean_packed", F.round(mean, 6)).withColumn("steps", F.greatest(F.lit(1), F.floor(F.col("examples") / (F.greatest(mean, F.lit(1e-9)) * batch))).cast("long"))


def epoch_batches(examples: DataFrame, room: int, batch: int, epochs: int = 1, parts: int | None = None, key: str = "id", size: str = "size") -> DataFrame:
    """epoch, batch, slot, segment of each example: every epoch shuffles and packs anew, and deals its sequences to batches.

    Sequences are counted through the parts; the last batch of an epoch may have free slots."""
    parts, out = parts or parts_for(examples), None
    for epoch in range(1, epochs + 1):
        found = packed(examples, room, epoch, parts, key, size).filter("sequence >= 0")
        last = found.groupBy("part").agg((F.max("sequence") + 1).alias("n"))  # a row for each part
        before = last.select(F.col("part").alias("p"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
        whole = F.col("before") + F.col("sequence")
        one = found.join(before, F.col("part") == F.col("p")).select(F.lit(epoch).alias("epoch"), F.floor(whole / batch).cast("long").alias("batch"), (whole % batch).cast("long").alias("slot"), "segment", "id", "size")
        out = one if out is None else out.unionByName(one)
    return out


def chunks(rows: DataFrame, n: int, key: str = "doc_id") -> DataFrame:
    """chunk: which of n contiguous chunks a row is in, by key; the first ones have one row more where n does not divide."""
    total = rows.count()
    short, more = divmod(total, n)
    marked = rows.withColumn("_key", F.coalesce(F.col(key).cast("long"), F.lit((1 << 63) - 1))).withColumn("_tie", F.xxhash64(*rows.columns))
    placed = ranges.running(ranges.ranged(marked, "_key", F.col("_tie")), F.lit(1), ["_key", "_tie"], into="_at")
    edge = more * (short + 1)
    at = F.when(F.col("_at") < edge, F.floor(F.col("_at") / (short + 1))).otherwise(more + F.floor((F.col("_at") - edge) / max(1, short)))
    return placed.withColumn("chunk", at.cast("long")).drop("_key", "_tie", "_at")


def batched(rows: DataFrame, n: int, key: str = "doc_id") -> DataFrame:
    """batch, place: batches of n rows by key; the last may be shorter."""
    marked = rows.withColumn("_key", F.coalesce(F.col(key).cast("long"), F.lit((1 << 63) - 1))).withColumn("_tie", F.xxhash64(*rows.columns))
    placed = ranges.running(ranges.ranged(marked, "_key", F.col("_tie")), F.lit(1), ["_key", "_tie"], into="_at")
    return placed.withColumn("batch", F.floor(F.col("_at") / n).cast("long")).withColumn("place", F.col("_at") % n).drop("_key", "_tie", "_at")


def batches(frames: DataFrame, size: int, vocab: int, order: Column, tokens: str = "w") -> DataFrame:
    """batch, slot, x, y of frames (arrays of ids) in a shuffled order, a hexadecimal hash; the batch that is not full goes.

    An id that is not below ``vocab``, or below zero, raises."""
    from ..functions import tokens as K

    placed = ranges.running(ranges.hashed(frames, "_order", order), F.lit(1), ["_order"], into="_at")
    whole = frames.count() // size * size
    pair = K.next_tokens(K.in_range(F.col(tokens), vocab))
    found = placed.filter(F.col("_at") < whole).withColumn("_p", pair)
    return found.withColumn("batch", F.floor(F.col("_at") / size).cast("long")).withColumn("slot", F.col("_at") % size).withColumn("x", F.col("_p.x")).withColumn("y", F.col("_p.y")).drop("_order", "_at", "_p")
