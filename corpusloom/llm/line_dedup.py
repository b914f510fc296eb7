"""Line dedup by a segment-partition edit join.

Lines (between line feeds, without white space around) are compared by edit
distance, up to a threshold that grows with the length of the longer of two
lines (``BANDS``; of none, lines are compared for equality).  A line is split into
one segment more than the threshold, of nearly equal length.  Two lines within the
threshold share a segment of the longer's partner at a place shifted by few
characters, so each line probes the index with few substrings of the right
lengths, and the pairs found are verified by a banded bit-parallel automaton.  A
line just below a band is in the index of that band as well.

Segments of one number only ever meet one another, so the numbers are joined in
passes over the distinct lines, one after the other (``_passes``): what is shuffled
at a time is one pass's keys.  They travel packed, many to a row, by ranges of the
key; of a range, index entries come first, so that a task drops each probe that
meets none as it comes, and gives the lines of a large key out as they come,
whatever their number.

Lines that meet under one segment in a large group are compared as a block, and
where the group exceeds a block they are dealt anew.  At a threshold of one: by what is left of the line without one character; of the
lines that agree there, all that lack the same place differ in that place alone,
so linking them to the least of them connects all; no pair is lost and none of
the others is formed.  At a larger one: by the segments of what is left beside
the segment they share.  Groups that are still large are cut into blocks, and
each pair of blocks gives the edges of a forest that connects what is close.

Linked lines form classes; of each class, the first line of the smallest doc_id
stays, and every other line of it goes.

Cases: blank lines are neither counted nor removed; a null text has no lines; a
null doc_id comes last; rows of an equal doc_id are one document after the other,
in order of a hash of their texts, and equal rows are one; an empty table gives
no rows; a very long line is one line; further columns stay as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tables as T
from . import words as W
from .components import components

#: From how many characters of the longer line how many edits are allowed.
BANDS = ((0, 0), (20, 1), (40, 2), (100, 3))
GROUP, BLOCK = 32, 512
_CHARS = 11
#: Names of lines are hashes of 63 bits; the sign marks the index entries among signatures, and sorts them first.
_INDEX = np.int64(-(1 << 63))
_VALUES = W.mix(np.arange(1 << 16, dtype=np.uint64) + np.uint64(0x51))


def _values(chars: np.ndarray) -> np.ndarray:
    """A 64-bit value of each character."""
    if not len(chars) or chars.max() < len(_VALUES):
        return _VALUES[chars]
    return W.mix(chars.astype(np.uint64) + np.uint64(0x51))


_SOLID = np.ones(256, bool)
_SOLID[[9, 10, 11, 12, 13, 32]] = False


class Lines:
    """Lines of a column: row, number within the row, start and end in its bytes."""

    def __init__(self, column: pa.Array):
        data, offsets = W.utf8(column)
        feeds = np.flatnonzero(data == 10)
        start = np.concatenate([offsets[:-1], feeds + 1])
        row = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets[1:], feeds, "right")])
        order = np.argsort(row, kind="stable")
        start, row = start[order], row[order]
        end = np.minimum(np.append(feeds, len(data))[np.searchsorted(feeds, start)], offsets[1:][row])
        number = np.arange(len(row)) - np.searchsorted(row, row)
        places = np.flatnonzero(_SOLID[data])
        low, high = np.searchsorted(places, start), np.searchsorted(places, end)
        some = high > low
        self.row, self.number = row[some], number[some]
        self.start, self.end = places[low[some]], places[high[some] - 1] + 1
        self.data = data
        self.hash = W.run_hash(W.runs(_VALUES[data], _CHARS), self.start, self.end) >> np.uint64(1)
        self.rows = len(offsets) - 1

    @property
    def size(self) -> np.ndarray:
        """Characters of each line."""
        later = np.concatenate([[0], np.cumsum((self.data & 0xC0) == 0x80, dtype=np.int64)])
        return self.end - self.start - (later[self.end] - later[self.start])

    def words(self, pick: np.ndarray) -> pa.Array:
        """The lines picked, ascending, as strings."""
        start, end = self.start[pick], self.end[pick]
        step = np.zeros(len(self.data) + 1, np.int8)
        step[start] += 1
        step[end] -= 1
        data = self.data[np.cumsum(step[:-1], dtype=np.int8).view(bool)]
        offsets = np.concatenate([[0], np.cumsum(end - start)])
        try:
            data.tobytes().decode("utf-8")
        except UnicodeDecodeError:
            return pa.array([data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.string())
        return pa.LargeStringArray.from_buffers(len(pick), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())


def line_chunks(column, size: int = W.CHUNK_BYTES):
    data, offsets = W.utf8(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        to = min(n, max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1))
        yield row, Lines(column.slice(row, to - row))
        row = to


def segment(n: np.ndarray, i: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of segment i (from 0) of lines of n characters; the last segments are the longer ones."""
    short, longer = n // parts, n % parts
    at = i * short + np.maximum(0, i - (parts - longer))
    return at, short + (i >= parts - longer)


def _bands(edits) -> tuple:
    return ((0, edits),) if isinstance(edits, int) else tuple(edits)


def allowed(n: np.ndarray, bands) -> np.ndarray:
    """The threshold of lines of n characters."""
    return np.array([e for _, e in bands])[np.searchsorted([least for least, _ in bands], n, "right") - 1]


class Texts:
    """Whole lines of a column, as code points."""

    def __init__(self, column: pa.Array, start: np.ndarray | None = None, gone: np.ndarray | None = None):
        data, offsets = W.utf8(column)
        chars = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        begins = offsets if len(chars) == len(data) else np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
        if start is not None:  # what is left beside a part of each line
            keep = np.ones(len(chars) + 1, np.int64)
            np.add.at(keep, begins[:-1] + start, -1)
            np.add.at(keep, begins[:-1] + start + gone, 1)
            inside = np.cumsum(keep - 1)[:-1] >= 0
            chars = chars[inside]
            begins = begins - np.concatenate([[0], np.cumsum(gone)])
        self.chars, self.start, self.size = chars, begins[:-1], np.diff(begins)
        self.runs = W.runs(_values(chars), _CHARS)


def _signatures(x, pick: np.ndarray, edits: int, numbers, probe: bool = True):
    """(key, line, where the segment stands in it, its length, whether an index entry) of the lines picked, for segments of some
    numbers: index entries, and probes if asked for."""
    start, n, parts = x.start[pick], x.size[pick], edits + 1
    for i in numbers:
        for d in range(edits + 1 if probe else 1):
            at, size = segment(n - d, i, parts)
            low = np.maximum(-i, d - (edits - i)) if probe else 0
            high = np.minimum(i, d + (edits - i)) if probe else 0
            for shift in range(low, high + 1):
                p = at + shift
                ok = (p >= 0) & (p + size <= n) & (n - d >= parts)
                a = start[ok] + p[ok]
                code = (n[ok] - d).astype(np.uint64) * np.uint64(4096) + np.uint64(i * 64 + edits)
                key = W.mix(W.run_hash(x.runs, a, a + size[ok]) ^ W.mix(code))
                yield key, pick[ok], p[ok], size[ok], not (d or shift)


def _passes(most: int) -> list[tuple[int, ...]]:
    """Segment numbers by pass: the first and the last have about half as many probes as each of the others."""
    return [tuple(sorted({0, most}))] + [(i,) for i in range(1, most)]


def _banded(x, pick: np.ndarray, bands, numbers):
    """(key, line, where the segment stands, its length, whether an index entry, the threshold) of the lines picked for segments
    of some numbers, each line at its own threshold, and in the index of a band that a longer partner has."""
    own = allowed(x.size[pick], bands)
    for e in sorted({e for _, e in bands if e >= max(1, min(numbers))}):
        below = np.zeros(len(pick), bool)
        for d in range(1, e + 1):
            below |= allowed(x.size[pick] + d, bands) == e
        for some, probe in ((own == e, True), (below & (own != e), False)):
            for found in _signatures(x, pick[some], e, [i for i in numbers if i <= e], probe):
                yield *found, e


_FOUND = pa.schema([("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])


#: Entries that are packed at a time, of a row, of a range on average, and that a task holds before it looks for large keys.
_PACK, _ROW, _RANGE, _HELD = 1 << 19, 1 << 12, 1 << 19, 1 << 22
_PACKED = "part int, probe boolean, keys binary, lines binary"


def _packed(key: np.ndarray, line: np.ndarray, parts: int) -> pa.RecordBatch:
    """(key, line) as rows of many entries, each of one range of the key, and of index entries or probes alone."""
    place = ((key >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)) * np.uint64(2) + (line >= 0)
    place = place.astype(np.uint16 if 2 * parts <= 1 << 16 else np.uint64)
    order = np.argsort(place, kind="stable")
    key, line, place = key[order], line[order], place[order]
    cut = np.append(True, place[1:] != place[:-1])
    cut[::_ROW] = True
    at = np.flatnonzero(cut)
    offsets = pa.py_buffer((np.append(at, len(key)) * 8).astype(np.int32))
    blobs = [pa.Array.from_buffers(pa.binary(), len(at), [None, offsets, pa.py_buffer(np.ascontiguousarray(x))]) for x in (key, line)]
    return pa.RecordBatch.from_arrays([pa.array((place[at] >> 1).astype(np.int32)), pa.array((place[at] & 1).astype(bool)), *blobs], ["part", "probe", "keys", "lines"])


def _unpacked(column: pa.Array) -> np.ndarray:
    data = b"".join(x.as_buffer() for x in column)
    return np.frombuffer(data, np.int64)


def _within_sorted(key: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which keys a sorted table has."""
    if not len(table):
        return np.zeros(len(key), bool)
    return table[np.minimum(np.searchsorted(table, key), len(table) - 1)] == key


def _runs(group: int):
    """From the packed entries of a range, index entries first: the pairs (a, b) of lines of each key that few have, of which one
    is in the index, and the rows of all others (key, a), some of them twice.  Keys without an index entry have no pair."""

    def found(key=(), a=(), b=None):
        n = len(a)
        none = pa.nulls(n, pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(key) if b is None else none, pa.array(a & ~_INDEX), none if b is None else pa.array(b & ~_INDEX)], schema=_FOUND)

    def given(key: np.ndarray, line: np.ndarray):
        for at in range(0, len(key), 1 << 16):
            yield found(key[at : at + (1 << 16)], line[at : at + (1 << 16)])

    def ordered(key: np.ndarray, line: np.ndarray):
        """Sorted by both, equal ones once; where a key begins, and how many have it."""
        order = np.lexsort((line, key))
        key, line = key[order], line[order]
        new = np.append(True, (key[1:] != key[:-1]) | (line[1:] != line[:-1]))[: len(key)]
        key, line = key[new], line[new]
        at = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        return key, line, at, np.diff(np.append(at, len(key)))

    def closed(key: np.ndarray, line: np.ndarray):
        """All that is left of a range."""
        order = np.argsort(key)
        key, line = key[order], line[order]
        same = key[1:] == key[:-1]
        more = np.append(False, same) | np.append(same, False)  # a key of one entry has no pair
        if not more.any():
            return
        key, line, at, size = ordered(key[more[: len(key)]], line[more[: len(key)]])
        some = line[at] < 0
        for n in np.unique(size[some & (size > 1) & (size <= group)]).tolist():
            of = line[at[some & (size == n)][:, None] + np.arange(n)[None, :]]
            i, j = np.triu_indices(n, 1)
            for low in range(0, len(of), max(1, (1 << 16) // len(i))):
                part = of[low : low + max(1, (1 << 16) // len(i))]
                a, b = part[:, i].ravel(), part[:, j].ravel()
                ok = (a < 0) & ((a & ~_INDEX) != (b & ~_INDEX))  # the first of two is the one in the index
                a, b = a[ok] & ~_INDEX, b[ok] & ~_INDEX
                yield found(a=np.minimum(a, b), b=np.maximum(a, b))
        large = np.repeat(some & (size > group), size)
        yield from given(key[large], line[large])

    class Range:
        def __init__(self):
            self.keys, self.lines, self.n, self.most = [], [], 0, _HELD
            self.open = np.zeros(0, np.int64)  # large keys, whose lines go out as they come
            self.index = self.bits = None

        def known(self) -> None:
            """All index entries are here."""
            self.index = np.sort(np.concatenate([*self.keys, self.open]))
            self.bits = np.zeros(1 << max(10, int(8 * len(self.index)).bit_length()), bool)
            self.bits[self.index & (len(self.bits) - 1)] = True

        def add(self, key: np.ndarray, line: np.ndarray, probe: bool):
            if probe:
                if self.index is None:
                    self.known()
                met = np.flatnonzero(self.bits[key & (len(self.bits) - 1)])
                met = met[_within_sorted(key[met], self.index)]
                key, line = key[met], line[met]
            if len(self.open):
                out = _within_sorted(key, self.open)
                yield from given(key[out], line[out])
                key, line = key[~out], line[~out]
            self.keys.append(key)
            self.lines.append(line)
            self.n += len(key)
            if self.n > self.most:
                key, line, at, size = ordered(np.concatenate(self.keys), np.concatenate(self.lines))
                large = size > group
                self.open = np.sort(np.concatenate([self.open, key[at[large]]]))
                out = np.repeat(large, size)
                yield from given(key[out], line[out])
                self.keys, self.lines, self.n = [key[~out]], [line[~out]], int((~out).sum())
                self.most = max(_HELD, 2 * self.n)

        def end(self):
            if self.n:
                yield from closed(np.concatenate(self.keys), np.concatenate(self.lines))

    def run(batches):
        part, now = None, Range()
        for batch in batches:
            parts, probe = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("part", "probe"))
            at = np.flatnonzero(np.append(True, (parts[1:] != parts[:-1]) | (probe[1:] != probe[:-1]))[: len(parts)])
            for low, high in zip(at.tolist(), [*at[1:].tolist(), len(parts)], strict=True):
                if parts[low] != part:
                    yield from now.end()
                    part, now = parts[low], Range()
                for i in range(low, high, 256):
                    rows = slice(i, min(high, i + 256))
                    yield from now.add(*(_unpacked(batch.column(c)[rows]) for c in ("keys", "lines")), bool(probe[low]))
        yield from now.end()

    return T.light(run)


def _met(rows: DataFrame, sign, entries: int, group: int) -> DataFrame:
    """key, a, b: pairs of lines of one key where few have it, else the lines of the key (b null).

    sign: from a batch of the rows to (key, line) arrays, some ``entries`` in all."""
    spark = rows.sparkSession
    parts = max(2 * spark.sparkContext.defaultParallelism, -(-entries // _RANGE))

    def pack(batches):
        keys, lines, n = [], [], 0
        for batch in batches:
            for key, line in sign(batch):
                keys.append(key)
                lines.append(line)
                n += len(key)
                if n >= _PACK:
                    yield _packed(np.concatenate(keys), np.concatenate(lines), parts)
                    keys, lines, n = [], [], 0
        if n:
            yield _packed(np.concatenate(keys), np.concatenate(lines), parts)

    dealt = rows.mapInArrow(T.light(pack), _PACKED).repartitionById(parts, F.col("part")).sortWithinPartitions("part", "probe")
    return T.written(dealt.mapInArrow(_runs(group), "key long, a long, b long"))


def distinct_lines(documents: DataFrame, bands, min_chars: int = 0) -> DataFrame:
    """line (its hash), words of all distinct lines that a threshold above zero may concern."""
    most = max(e for _, e in bands)

    def run(batches):
        for batch in batches:
            for _, x in line_chunks(batch.column("text")):
                pick, size = np.sort(np.unique(x.hash, return_index=True)[1]), x.size
                pick = pick[(size[pick] >= max(min_chars, 2)) & (allowed(size[pick] + most, bands) > 0)]
                whole = pa.RecordBatch.from_arrays([pa.array(x.hash[pick].view(np.int64)), x.words(pick)], ["line", "words"])
                for at in range(0, len(pick), 4096):
                    yield whole.slice(at, 4096)

    def once(batches):
        last = None
        for batch in batches:
            name = batch.column("line").to_numpy(zero_copy_only=False)
            if len(name):
                new = np.append(last is None or name[0] != last, name[1:] != name[:-1])
                last = name[-1]
                yield batch.filter(pa.array(new))

    found = documents.mapInArrow(run, "line long, words string").repartition("line").sortWithinPartitions("line")
    return T.written(found.mapInArrow(once, "line long, words string"))


def _pieces(column: pa.Array, size: int = W.CHUNK_BYTES):
    """Bounds of the rows of a column, so much text at a time."""
    _, offsets = W.utf8(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        to = min(n, max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1))
        yield row, to
        row = to


def edit_links(documents: DataFrame, edits=BANDS, min_chars: int = 0, group: int = GROUP) -> DataFrame:
    """Edges (a, b) of line hashes that connect all distinct lines within ``edits`` edits of one another.

    documents: text. ``edits``: a number for lines of every length, or (least length of the longer line, number) ascending."""
    bands = _bands(edits)
    most = max(e for _, e in bands)
    if not most:
        return documents.sparkSession.createDataFrame([], "a long, b long")
    lines = distinct_lines(documents, bands, min_chars)

    passes, count = _passes(most), lines.count()

    def sign(numbers: tuple[int, ...]):
        def run(batch: pa.RecordBatch):
            for low, high in _pieces(batch.column("words")):
                names, x = batch.column("line").to_numpy(zero_copy_only=False)[low:high], Texts(batch.column("words").slice(low, high - low))
                for key, line, _, _, index, _ in _banded(x, np.arange(high - low), bands, numbers):
                    yield key, names[line] | _INDEX if index else names[line]

        return run

    def spots(number: int) -> DataFrame:
        """key, line, at, size, edits: where the shared segment of a large group stands in its lines."""

        def run(batch: pa.RecordBatch):
            for low, high in _pieces(batch.column("words")):
                part = batch.slice(low, high - low)
                wanted, names = (part.column(c).to_numpy(zero_copy_only=False) for c in ("key", "line"))
                for key, row, at, size, _, e in _banded(Texts(part.column("words")), np.arange(high - low), bands, passes[number]):
                    mine = key.view(np.int64) == wanted[row]
                    yield {"key": wanted[row[mine]], "line": names[row[mine]], "at": at[mine], "size": size[mine], "edits": np.full(int(mine.sum()), e)}

        return T.map_batches(huge.filter(F.col("number") == number).select("key", "line").join(known, "line"), run, "key long, line long, at int, size int, edits int")

    # a line has at most (most + 1) ** 2 / 2 + 1 entries in a pass, and few in the index of another band
    found = [_met(lines, sign(numbers), count * ((most + 1) ** 2 // 2 + 1), group) for numbers in passes]
    every = found[0].withColumn("number", F.lit(0))
    for i in range(1, len(passes)):
        every = every.unionByName(found[i].withColumn("number", F.lit(i)))
    wanted = every.select(F.explode(F.array("a", "b")).alias("line")).filter("line is not null").distinct()
    known = T.written(lines.join(wanted.hint("merge"), "line", "left_semi"))  # the lines that met another
    pairs = every.filter("b is not null").select("a", "b")
    # groups that fit a block are compared as they are; larger ones are dealt anew before
    large = every.filter("b is null").select("key", F.col("a").alias("line"), "number").distinct()
    sizes = large.groupBy("key").agg(F.count("*").alias("lines"))
    large = T.written(large.join(sizes, "key"))
    blocked = large.filter(F.col("lines") <= BLOCK).select("key", "line")
    huge = large.filter(F.col("lines") > BLOCK)
    numbers = sorted(r["number"] for r in huge.select("number").distinct().collect())  # as many as passes
    if numbers:
        placed = spots(numbers[0])
        for i in numbers[1:]:
            placed = placed.unionByName(spots(i))
        placed = T.written(placed)
        pairs = pairs.unionByName(_dealt_anew(placed.filter("edits = 1").drop("edits"), known))
        if most > 1:
            far = placed.filter("edits > 1")
            again = _met(far.join(known, "line"), _beside, far.count() * (most + 1) ** 3 // 2, group)
            pairs = pairs.unionByName(again.filter("b is not null").select("a", "b"))
            blocked = blocked.unionByName(again.filter("b is null").select("key", F.col("a").alias("line")).distinct())
    blocked = _in_blocks(blocked, known, bands)
    pairs = pairs.distinct()
    both = pairs.join(known.select(F.col("line").alias("a"), F.col("words").alias("x")), "a").join(known.select(F.col("line").alias("b"), F.col("words").alias("y")), "b")

    def verify(batch: pa.RecordBatch):
        close = close_pairs(batch.column("x"), batch.column("y"), bands)
        yield {"a": batch.column("a").filter(pa.array(close)), "b": batch.column("b").filter(pa.array(close))}

    links = T.map_batches(both, verify, "a long, b long")
    return links.unionByName(blocked)


_BINS = 1 << 5


def _letters(words: pa.Array) -> np.ndarray:
    """How often each of some classes of letters stands in each line; an edit changes two of the counts by one at most."""
    data, offsets = W.utf8(words)
    chars = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    begins = offsets if len(chars) == len(data) else np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    row = np.repeat(np.arange(len(words)) * _BINS, np.diff(begins))
    return np.bincount(row + (chars * np.uint32(2654435761) >> np.uint32(32 - 5)), minlength=len(words) * _BINS).reshape(len(words), _BINS).astype(np.int32)


#: Pairs of which a line is longer are followed along their diagonals, one by one.
LONG = 1_000


def close_pairs(x: pa.Array, y: pa.Array, bands) -> np.ndarray:
    """Whether each pair is within the threshold of its longer line."""
    size = np.maximum(*[pc.utf8_length(c).to_numpy(zero_copy_only=False) for c in (x, y)])
    most = allowed(size, bands)
    out = np.zeros(len(most), bool)
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = within_far(*[np.frombuffer(c[i].as_py().encode("utf-32-le"), np.uint32) for c in (x, y)], int(most[i]))
    for e in np.unique(most):
        at = np.flatnonzero((most == e) & (size <= LONG))
        at = at[np.abs(_letters(x.take(pa.array(at))) - _letters(y.take(pa.array(at)))).sum(axis=1) <= 2 * e]
        out[at] = within(x.take(pa.array(at)), y.take(pa.array(at)), int(e))
    return out


def within_far(a: np.ndarray, b: np.ndarray, edits: int) -> bool:
    """The same for a pair of long lines: how far each diagonal of the band gets with so many edits, by whole equal stretches."""

    def equal(i: int, j: int) -> int:
        n, at = min(len(a) - i, len(b) - j), 0
        while at < n:
            to = min(n, at + 8192)
            differ = a[i + at : i + to] != b[j + at : j + to]
            if differ.any():
                return at + int(np.argmax(differ))
            at = to
        return n

    reach = {0: equal(0, 0)}
    for e in range(edits + 1):
        if reach.get(len(b) - len(a), -1) >= len(a):
            return True
        if e == edits:
            break
        then = {}
        for k in range(-e - 1, e + 2):  # b's place is a's and k
            i = max(reach.get(k, -2) + 1, reach.get(k - 1, -2), reach.get(k + 1, -2) + 1)
            i = min(i, len(a), len(b) - k)
            if i >= 0 and i + k >= 0:
                then[k] = i + equal(i, i + k)
        reach = then
    return False


def _beside(batch: pa.RecordBatch):
    """Key, line of large groups dealt anew by the segments of what is left: lines within some edits that share a segment
    are within as many beside it.  Where the segment is so short that nothing can be split, the key stays."""
    short = batch.column("size").to_numpy(zero_copy_only=False) < 3
    key, line = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "line"))
    yield key[short].view(np.uint64), line[short] | _INDEX
    for low, high in _pieces(batch.column("words")):
        part = batch.slice(low, high - low)
        keys, names, at, size, edits = (part.column(c).to_numpy(zero_copy_only=False) for c in ("key", "line", "at", "size", "edits"))
        x = Texts(part.column("words"), at.astype(np.int64), size.astype(np.int64))
        for e in np.unique(edits).tolist():
            pick = np.flatnonzero(~short[low:high] & (edits == e))
            for key, line, _, _, index in _signatures(x, pick, e, range(e + 1)):
                yield W.mix(key ^ W.mix(keys[line].view(np.uint64))), names[line] | _INDEX if index else names[line]


def _in_blocks(large: DataFrame, lines: DataFrame, bands) -> DataFrame:
    """Verified edges of large groups: each pair of blocks of a group is a task of bounded size."""
    sizes = large.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = large.join(sizes, "key").withColumn("own", F.pmod(F.hash("line"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", "line", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))

    def connect(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        found = _forest(table.column("words").combine_chunks(), table.column("own").to_numpy(), bands)
        names = table.column("line").to_numpy()
        return pa.table({"a": pa.array(names[found[:, 0]], pa.int64()), "b": pa.array(names[found[:, 1]], pa.int64())})

    # as many parts as the session deals to: these tasks are bound by their work, not by their bytes
    parts = int(large.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.join(lines, "line").repartition(parts, "key", "low", "high").groupBy("key", "low", "high").applyInArrow(connect, "a long, b long")


_BULK = 1 << 16


def _forest(words: pa.Array, own: np.ndarray, bands) -> np.ndarray:
    """Pairs (i, j) of close lines that connect all that are close; between two blocks, or within the only one.

    An edit changes the length by one and two counts of letters at most, which most pairs fail; the others are verified
    many at a time, but for those that are connected by then."""
    if isinstance(words, pa.ChunkedArray):
        words = words.combine_chunks()
    n, across = len(words), len(np.unique(own)) > 1
    size, letters = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64), _letters(words)
    most = int(max(e for _, e in bands))
    label, out = np.arange(n), []
    left, right, held = [], [], 0

    def settle() -> None:
        nonlocal left, right, held
        i, j = np.concatenate(left), np.concatenate(right)
        left, right, held = [], [], 0
        apart = label[i] != label[j]
        i, j = i[apart], j[apart]
        if not len(i):
            return
        ok = close_pairs(words.take(pa.array(i)), words.take(pa.array(j)), bands)
        for a, b in zip(i[ok].tolist(), j[ok].tolist(), strict=True):
            if label[a] != label[b]:
                label[label == label[b]] = label[a]
                out.append((a, b))

    for i in range(n - 1):
        j = np.arange(i + 1, n)
        j = j[(label[j] != label[i]) & (np.abs(size[j] - size[i]) <= most)]
        j = j[own[j] != own[i]] if across else j
        if len(j):
            j = j[np.abs(letters[j] - letters[i]).sum(axis=1) <= 2 * most]
            left.append(np.full(len(j), i))
            right.append(j)
            held += len(j)
        if held and (held >= _BULK or i == 0):  # the first one connects most of a group that is close
            settle()
    if held:
        settle()
    return np.array(out, np.int64).reshape(-1, 2)


def _dealt_anew(large: DataFrame, lines: DataFrame) -> DataFrame:
    """Pairs to verify of large groups, as stars.

    For each line of a group: what is left beside the segment, whole, and without each of its characters. Lines one
    substitution apart agree without the character, at one place; lines one insertion apart where one is whole."""

    def run(batch: pa.RecordBatch):
        keys, names = batch.column("key").to_numpy(zero_copy_only=False), batch.column("line").to_numpy(zero_copy_only=False)
        at, size = batch.column("at").to_numpy(zero_copy_only=False), batch.column("size").to_numpy(zero_copy_only=False)
        for i, text in enumerate(batch.column("words").to_pylist()):
            rest = np.frombuffer((text[: at[i]] + text[at[i] + size[i] :]).encode("utf-32-le"), np.uint32)
            n, split = len(rest), int(at[i])
            runs = W.runs(_values(rest), _CHARS)
            sums, down = runs
            k = np.arange(n)
            without = (sums[k] + (sums[n] - sums[k + 1]) * down[1]) if n else np.zeros(0, np.uint64)
            whole = np.append(without, sums[n]) if n else np.zeros(1, np.uint64)
            left = split - np.append(k < split, False).astype(np.int64)  # where the segment stood in what is left
            key = W.mix(W.mix(whole + left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(int(keys[i]) & (2**64 - 1)))
            yield {"key": key, "line": np.full(n + 1, names[i]), "gone": np.append(k, -1)}

    found = T.map_batches(large.join(lines, "line"), run, "key long, line long, gone int")
    whole = found.filter("gone < 0").groupBy("key").agg(F.min("line").alias("head"))
    to_whole = found.join(whole, "key").filter("line <> head").select("head", "line")
    heads = found.filter("gone >= 0").groupBy("key", "gone").agg(F.min("line").alias("head"), F.count("*").alias("n")).filter("n > 1")
    to_heads = found.join(heads.drop("n"), ["key", "gone"]).filter("line <> head").select("head", "line")
    return to_whole.unionByName(to_heads).select(F.least("head", "line").alias("a"), F.greatest("head", "line").alias("b"))


def within(x: pa.Array, y: pa.Array, edits: int) -> np.ndarray:
    """Whether the edit distance of each pair is at most ``edits``, by a banded bit-parallel automaton.

    Bit k of level e: with e edits or fewer, so many characters of x are matched as of y plus k - edits."""
    a, b = [W.utf8(c) for c in (x, y)]
    chars, first, size = [], [], []
    for data, offsets in (a, b):
        points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        begins = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
        chars.append(np.concatenate([points, [0xFFFFFFFF]]).astype(np.uint32))
        first.append(begins[:-1])
        size.append(np.diff(begins))
    band = 2 * edits + 1
    mask = np.uint32((1 << band) - 1)
    near = np.abs(size[0] - size[1]) <= edits
    out = np.zeros(len(near), bool)
    live = np.flatnonzero(near)
    live = live[np.argsort(-size[1][live], kind="stable")]
    level = [np.full(len(live), ((1 << (e + 1)) - 1) << edits & int(mask), np.uint32) for e in range(edits + 1)]
    p, t, n, m = first[0][live], first[1][live], size[1][live], size[0][live]
    last = len(chars[0]) - 1
    j = 0
    while len(n) and j < int(n[0]):
        k = int(np.searchsorted(-n, -j, "left"))
        c = chars[1][t[:k] + j]
        match = np.zeros(k, np.uint32)
        for bit in range(band):
            i = j + bit - edits
            inside = (i >= 0) & (i < m[:k])
            same = chars[0][np.where(inside, p[:k] + i, last)] == c
            match |= (same & inside).astype(np.uint32) << np.uint32(bit)
        before = None
        for e in range(edits + 1):
            old = level[e][:k].copy()
            new = old & match
            if e:
                new |= before | before >> np.uint32(1) | (level[e - 1][:k] << np.uint32(1))
            before = old
            level[e][:k] = new & mask
        j += 1
        if j % 16 == 0:  # pairs without a way left are done
            alive = level[edits] != 0
            if np.count_nonzero(alive) < 0.8 * len(alive):
                live, p, t, n, m = live[alive], p[alive], t[alive], n[alive], m[alive]
                level = [x[alive] for x in level]
    if len(live):
        out[live] = (level[edits] >> (m - n + edits).astype(np.uint32) & 1).astype(bool)
    return out


@T.tidy
def removed_lines(documents: DataFrame, edits=BANDS, min_chars: int = 0, group: int = GROUP) -> DataFrame:
    """_key, text_hash, n_lines, removed (numbers of lines that go, from 0, blank lines counted) of each distinct document row, and copies of the row."""
    docs = documents.select(T.doc_key().alias("_key"), F.coalesce("text", F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))

    def occurrences(batch: pa.RecordBatch):
        for at, x in line_chunks(batch.column("text")):
            of, counts = batch.slice(at, x.rows), np.bincount(x.row, minlength=x.rows)
            yield {"_key": of.column("_key"), "text_hash": of.column("text_hash"), "numbers": T.lists(x.number.astype(np.int32), counts), "lines": T.lists(x.hash, counts)}

    found = T.written(T.map_batches(docs, occurrences, "_key long, text_hash long, numbers array<int>, lines array<long>"))
    place = F.struct("_key", "text_hash", F.col("x.numbers").alias("number"))
    first = found.select("_key", "text_hash", F.explode(F.arrays_zip("numbers", "lines")).alias("x")).groupBy(F.col("x.lines").alias("line")).agg(F.min(place).alias("first"))
    classes = components(edit_links(docs.select("text"), edits, min_chars, group))
    # of each class the first line stays; no line's or class's occurrences ever gather
    kinds = first.join(classes, F.col("line") == F.col("node"), "left").groupBy(F.coalesce("component", "line").alias("kind")).agg(F.min("first").alias("first"))
    kept = kinds.select("first.*").groupBy("_key", "text_hash").agg(F.collect_list("number").alias("kept"))  # of one document
    heads = found.groupBy("_key", "text_hash").agg(F.first("numbers").alias("numbers"), F.count("*").alias("copies"))
    lost = F.array_except("numbers", F.coalesce("kept", F.expr("cast(array() as array<int>)")))
    return heads.join(kept, ["_key", "text_hash"], "left").select("_key", "text_hash", F.size("numbers").cast("long").alias("n_lines"), lost.alias("removed"), "copies")


def kept_text(text, removed):
    """A text without the lines of the numbers given."""
    lines = F.split(text, "\n", -1)
    return F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(removed, i)), "\n")


def deduplicated(documents: DataFrame, **options) -> DataFrame:
    """Documents with their kept text; all other columns stay."""
    found = removed_lines(documents, **options).select(F.col("_key").alias("_k"), F.col("text_hash").alias("_h"), F.col("removed").alias("_removed"))
    columns = [F.coalesce("text", F.lit("")).alias(c) if c == "text" else F.col(c) for c in documents.columns]
    docs = documents.select(F.struct(*columns).alias("_row"), T.doc_key().alias("_k"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_h"))
    joined = docs.join(found, ["_k", "_h"])
    return joined.select(*[kept_text(F.col("_row.text"), F.col("_removed")).alias(c) if c == "text" else F.col(f"_row.`{c}`") for c in documents.columns])


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    found = removed_lines(T.read(spark, sf_dir, "documents")).withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return found.select(
        F.when(F.col("_key") != T.LAST_ID, F.col("_key")).alias("doc_id"),
        "n_lines",
        F.size("removed").cast("long").alias("n_removed"),
        F.sha2(F.encode(F.array_join(F.transform("removed", lambda x: x.cast("string")), ","), "UTF-8"), 256).alias("removed_sha256"),
    )
