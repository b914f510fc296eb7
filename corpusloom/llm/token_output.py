"""Token ids in a compact binary file format: canonical length-limited Huffman blocks.

Documents are range-partitioned and sorted by doc_id, encoded with a public
tokenizer, ended by an id, and cut into blocks of whole documents.  The global
counts of the ids give one canonical code.  A dataset is a folder:

* ``code``: token_id, bits (lengths of the canonical code);
* ``parts``: part, start (ids of all parts before), limit, step;
* ``blocks/part=N``: block, start (ids of the part before the block), n_tokens,
  doc_ids, doc_tokens, offsets (bit offset of every ``step`` ids), payload.

Parts and blocks ascend by doc_id.  Blocks decode without one another, and the
parts of a block between two offsets as well.  Any file system that Spark
writes to holds it.

Cases: a null or empty text has only the end id; a null doc_id comes last;
equal doc_ids are ordered by a hash of the text; repeated rows each stay; an empty table gives
no blocks; a very long text is one document of one block; further columns are
ignored.  With ``special``, names of added tokens in a text get their ids, as
by the library's default; else they are ordinary text.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import huffman
from . import tables as T
from . import words as W

BLOCK_TOKENS, END_ID = 1 << 16, 0
_SPLIT = np.zeros(256, bool)
_SPLIT[list(range(0x21, 0x7F)) + list(range(0x80, 0x100))] = True


class UnitEncoder:
    """Encodes texts by pieces, each distinct piece once.

    A text is cut before each single space that stands between two characters
    that are no white space.  The byte-level pre-tokenizer cuts there as well,
    so the pieces' ids put together are the text's ids.  The table of known
    pieces is emptied when it is full.

    With ``special``, a text is cut around the names of added tokens too, as the
    tokenizer does before all else.  Texts with names that take blanks or words
    beside them into account are one piece."""

    def __init__(self, path: str, special: bool = False, most: int = 3_000_000):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        added = [x for x in self.tokenizer.get_added_tokens_decoder().values() if special or not x.special]
        names = sorted((x.content.encode() for x in added), key=len, reverse=True)
        self.names = re.compile(b"|".join(map(re.escape, names))) if names else None
        self.alone = not any(x.lstrip or x.rstrip or x.single_word for x in added)
        spelled = self.tokenizer.get_vocab(with_added_tokens=False)
        self.bytes_of = np.zeros(max(spelled.values()) + 1, np.int64)
        self.bytes_of[list(spelled.values())] = [len(x) for x in spelled]  # a byte is a character of the vocabulary
        self.most = most
        self._empty()

    def _empty(self):
        """Known pieces: an open table of keys (0: free) and slots; first and size: a slot's ids."""
        self.bits = 16
        self.keys, self.slots = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
        self.ids = np.zeros(1 << 16, np.uint32)
        self.first, self.size, self.known, self.used = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32), 0, 0

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Slots of keys, -1 for those not known."""
        at = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        there = self.keys[at]
        out = np.where(there == keys, self.slots[at], -1)
        rest = np.flatnonzero((there != keys) & (there != 0))
        while len(rest):
            at[rest] = (at[rest] + 1) & ((1 << self.bits) - 1)
            there = self.keys[at[rest]]
            same = there == keys[rest]
            out[rest[same]] = self.slots[at[rest[same]]]
            rest = rest[~same & (there != 0)]
        return out

    def _add(self, keys: np.ndarray, slots: np.ndarray):
        """Distinct keys that are not known."""
        if self.known > 3 << self.bits - 2:
            old = np.flatnonzero(self.keys)
            keys, slots = np.concatenate([self.keys[old], keys]), np.concatenate([self.slots[old], slots])
            while self.known > 1 << self.bits - 1:
                self.bits += 1
            self.keys, self.slots = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
        at = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        rest = np.arange(len(keys))
        while len(rest):
            free = rest[self.keys[at[rest]] == 0]
            self.keys[at[free]] = keys[free]  # of several at one place, one wins
            won = self.keys[at[rest]] == keys[rest]
            self.slots[at[rest[won]]] = slots[rest[won]]
            rest = rest[~won]
            at[rest] = (at[rest] + 1) & ((1 << self.bits) - 1)

    def _learn(self, keys: np.ndarray, pieces: list[bytes], whole: np.ndarray):
        """whole: pieces that begin and end at a cut.  Put together, they are one text cut at the same places."""
        for of in (np.flatnonzero(whole), np.flatnonzero(~whole)):
            for at in range(0, len(of), 4096):
                mine = of[at : at + 4096].tolist()
                if whole[mine[0]]:
                    flat = np.array(self.tokenizer.encode_batch_fast([b"".join(pieces[i] for i in mine).decode()], add_special_tokens=False)[0].ids, np.uint32)
                    ends = np.cumsum([len(pieces[i]) for i in mine])
                    sizes = np.diff(np.searchsorted(np.cumsum(self.bytes_of[flat]), ends), prepend=-1)
                else:
                    found = [x.ids for x in self.tokenizer.encode_batch_fast([pieces[i].decode() for i in mine], add_special_tokens=False)]
                    sizes = np.array([len(x) for x in found], np.int64)
                    flat = np.fromiter((i for x in found for i in x), np.uint32, int(sizes.sum()))
                while self.used + len(flat) > len(self.ids):
                    self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
                n = self.known
                while n + len(mine) > len(self.first):
                    self.first, self.size = np.concatenate([self.first, self.first]), np.concatenate([self.size, self.size])
                self.ids[self.used : self.used + len(flat)] = flat
                self.size[n : n + len(mine)] = sizes
                self.first[n : n + len(mine)] = self.used + np.cumsum(sizes) - sizes
                self.used += len(flat)
                self.known += len(mine)
                self._add(keys[mine], np.arange(n, n + len(mine), dtype=np.int32))

    def _around(self, data: np.ndarray, offsets: np.ndarray, cut: np.ndarray) -> np.ndarray:
        """Where names of added tokens begin and end; cuts that are none beside them are taken back."""
        raw, out = data.tobytes(), []
        if self.names is None or not self.names.search(raw):
            return np.zeros(0, np.int64)
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            found = [(a + m.start(), a + m.end()) for m in self.names.finditer(raw[a:b])]
            if found and not self.alone:
                cut[a:b] = False
            elif found:
                for x, y in found:
                    cut[x + 1 : y] = False
                    out += [x, y]
        return np.array(out, np.int64)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each text has."""
        n = len(data)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        cut = np.zeros(n + 1, bool)
        if n > 2:
            plain = _SPLIT[data]
            cut[1 : n - 1] = (data[1:-1] == 0x20) & plain[:-2] & plain[2:]
            at = np.flatnonzero(cut)
            after, before = data[at + 1], data[at - 1]
            wide = (after >= 0xE1) & (after <= 0xE3) | (after == 0xC2) & np.isin(data[np.minimum(at + 2, n - 1)], (0x85, 0xA0))
            wide |= (before >= 0x80) & ((data[np.maximum(at - 2, 0)] == 0xC2) & np.isin(before, (0x85, 0xA0)) | np.isin(data[np.maximum(at - 3, 0)], (0xE1, 0xE2, 0xE3)))
            cut[at[wide]] = False
        edges = np.concatenate([offsets, self._around(data, offsets, cut)])
        inner = cut.copy()
        cut[edges] = True
        inner[edges] = False
        edges = np.flatnonzero(cut)
        start, end = edges[:-1], edges[1:]
        inner = inner[start] & inner[end]
        keys = np.maximum(W.run_hash(W.runs(W._byte_values(False)[data], 2), start, end), np.uint64(1))
        which = self._find(keys)
        new = np.flatnonzero(which < 0)
        if len(new):
            distinct, index = np.unique(keys[new], return_index=True)
            if self.known + len(distinct) > self.most:
                new = np.arange(len(keys))
                distinct, index = np.unique(keys, return_index=True)
                self.most = max(self.most, 2 * len(distinct))
                self._empty()
            raw, at = data.tobytes(), new[index]
            self._learn(distinct, [raw[a:b] for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)], inner[at])
            which[new] = self._find(keys[new])
        size, first = self.size[which].astype(np.int64), self.first[which]
        total = np.cumsum(size)
        ids = self.ids[np.repeat(first - (total - size), size) + np.arange(int(total[-1]))]
        sums = np.concatenate([[0], total])
        return ids, np.diff(sums[np.searchsorted(start, offsets)])


def _encoder(path: str, special: bool = False) -> UnitEncoder:
    """One for each stage in a worker."""
    return T.held(UnitEncoder, path, special)


def _blocks(ids, texts, encoder: UnitEncoder, end_id: int):
    """(doc_ids, ids with end ids, ids of each document) of a few documents at a time."""
    for chunk in W.chunks(texts, W.SPACE, size=1 << 19):
        tokens, counts = encoder.encode(chunk.data, chunk.offsets)
        out = np.full(len(tokens) + chunk.rows, end_id, np.uint32)
        keep = np.ones(len(out), bool)
        keep[np.cumsum(counts + 1) - 1] = False
        out[keep] = tokens
        yield ids[chunk.row : chunk.row + chunk.rows], out, counts + 1


def _encoded(documents: DataFrame, path: str, end_id: int, block_tokens: int, special: bool) -> DataFrame:
    """Blocks of ids in the order of doc_id, compressed for the way to the counts."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("_tie", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_last(), "_tie"]
    # rows of one doc_id, and even equal rows, may fill several parts
    docs = docs.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*order, "_row").sortWithinPartitions(*order, "text").drop("_tie", "_row")

    def run(batches):
        encoder, part = _encoder(path, special), TaskContext.get().partitionId()
        pack = zstandard.ZstdCompressor(level=3)
        held, block, start = [], 0, 0

        def flush():
            nonlocal held, block, start
            tokens = np.concatenate([x[1] for x in held])
            count = np.bincount(tokens)
            used = np.flatnonzero(count)
            count = count[used]
            wide = np.uint16 if used[-1] < 1 << 16 else np.uint32
            row = {
                "part": [part], "block": [block], "start": [start], "n_tokens": [len(tokens)],
                "doc_ids": [[i for x in held for i in x[0]]], "doc_tokens": [np.concatenate([x[2] for x in held])],
                "used": [used.astype(np.int32)], "count": [count.astype(np.int64)],
                "bytes_each": [wide().itemsize], "ids": [pack.compress(tokens.astype(wide).tobytes())],
            }
            held, block, start = [], block + 1, start + len(tokens)
            return pa.RecordBatch.from_arrays([pa.array(row[x.name], x.type) for x in _BLOCK], schema=_BLOCK)

        size = 0
        for batch in batches:
            for x in _blocks(batch.column("doc_id").to_pylist(), batch.column("text"), encoder, end_id):
                held.append(x)
                size += len(x[1])
                if size >= block_tokens:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return docs.mapInArrow(T.light(run), "part int, block int, start long, n_tokens long, doc_ids array<long>, doc_tokens array<long>, used array<int>, count array<long>, bytes_each int, ids binary")


_BLOCK = pa.schema(
    [("part", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())), ("used", pa.list_(pa.int32())), ("count", pa.list_(pa.int64())), ("bytes_each", pa.int32()), ("ids", pa.binary())]
)


def write_tokens(documents: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS, limit: int = huffman.LIMIT, step: int = huffman.STEP, special: bool = False) -> None:
    """Encode documents (doc_id, text) into a dataset at ``path``; with ``special``, names of added tokens in a text are these tokens."""
    spark = documents.sparkSession
    blocks = T.written(_encoded(documents, tokenizer, end_id, block_tokens, special))
    pairs = blocks.select(F.explode(F.arrays_zip("used", "count")).alias("x")).groupBy(F.col("x.used").alias("token_id")).agg(F.sum("x.count").alias("n"))
    counted = pairs.toPandas()  # as many rows as the vocabulary has ids
    counts = np.zeros(int(counted["token_id"].max()) + 1 if len(counted) else 1, np.int64)
    counts[counted["token_id"].to_numpy()] = counted["n"].to_numpy()
    lengths = huffman.code_lengths(counts, limit)
    totals = sorted((r["part"], r["n"]) for r in blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())  # a row for each task
    starts, at = [], 0
    for part, n in totals:
        starts.append((part, at, limit, step))
        at += n
    spark.createDataFrame([(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)], "token_id int, bits int").coalesce(1).write.parquet(f"{path}/code")
    spark.createDataFrame(starts, "part int, start long, limit int, step int").coalesce(1).write.parquet(f"{path}/parts")
    shared = spark.sparkContext.broadcast(lengths)

    def pack(batch: pa.RecordBatch):
        code, unpack = _code(shared.value.tobytes()), zstandard.ZstdDecompressor()
        for i in range(batch.num_rows):
            ids = np.frombuffer(unpack.decompress(batch.column("ids")[i].as_py()), f"<u{batch.column('bytes_each')[i].as_py()}")
            payload, offsets = code.encode(ids, step)
            yield {x: batch.column(x).slice(i, 1) for x in ("part", "block", "start", "n_tokens", "doc_ids", "doc_tokens")} | {"offsets": [offsets], "payload": [payload]}

    schema = "part int, block int, start long, n_tokens long, doc_ids array<long>, doc_tokens array<long>, offsets array<long>, payload binary"
    columns = ("part", "block", "start", "n_tokens", "doc_ids", "doc_tokens", "bytes_each", "ids")
    packed = T.map_batches(blocks.select(*columns).sortWithinPartitions("part", "block"), pack, schema)
    packed.sortWithinPartitions("part", "block").write.option("compression", "zstd").partitionBy("part").parquet(f"{path}/blocks")
    T.forget(spark, blocks)


@lru_cache(maxsize=2)
def _code(lengths: bytes) -> huffman.Code:
    return huffman.Code(np.frombuffer(lengths, np.uint8))


def read_tokens(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, and its ids."""
    lengths = spark.read.parquet(f"{path}/code").toPandas()  # as many rows as the vocabulary has ids
    bits = np.zeros(int(lengths["token_id"].max()) + 1 if len(lengths) else 1, np.uint8)
    bits[lengths["token_id"].to_numpy()] = lengths["bits"].to_numpy()
    parts = spark.read.parquet(f"{path}/parts").collect()  # a row for each task that wrote
    starts, step = {r["part"]: r["start"] for r in parts}, parts[0]["step"] if parts else huffman.STEP
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids
    if not parts:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(bits)

    def unpack(batch: pa.RecordBatch):
        code = _code(shared.value.tobytes())
        for at in range(0, batch.num_rows, 32):
            part = batch.slice(at, 32)
            n = part.column("n_tokens").to_numpy(zero_copy_only=False)
            found = code.decode(part.column("payload").to_pylist(), [np.array(x, np.int64) for x in part.column("offsets").to_pylist()], n, step)
            each = part.column("doc_tokens").flatten().to_numpy(zero_copy_only=False)
            docs = np.asarray(part.column("doc_tokens").value_lengths())
            ends = np.cumsum(each)
            raw = found.astype("<u4")
            first = np.array([starts[x] for x in part.column("part").to_pylist()], np.int64) + part.column("start").to_numpy(zero_copy_only=False) - (np.cumsum(n) - n)
            out = {"doc_id": part.column("doc_ids").flatten(), "start": ends - each + np.repeat(first, docs), "n_tokens": each}
            out["ids_crc32"] = [zlib.crc32(raw[b - k : b]) for b, k in zip(ends.tolist(), each.tolist(), strict=True)]
            yield out | ({"ids": T.lists(raw.view(np.int32), each)} if ids else {})

    return T.map_batches(spark.read.parquet(f"{path}/blocks"), unpack, schema)


def encoded_documents(documents: DataFrame, tokenizer: str, ids: bool = False, special: bool = False) -> DataFrame:
    """Write documents' ids into a new dataset in the shared folder and read them back."""
    spark = documents.sparkSession
    path = T.folder(spark, "tokens")
    write_tokens(documents, path, tokenizer, special=special)
    return read_tokens(spark, path, ids)


def public_tokenizer(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_token_output(spark, sf_dir: str) -> DataFrame:
    return encoded_documents(T.read(spark, sf_dir, "documents"), public_tokenizer(), special=True)
