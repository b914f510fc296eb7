"""Byte-level pre-tokens, vocabulary rules, and token windows."""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from ..sources.writers import scratch

# The pre-token branches, in order, and the core special tokens.
PRE_TOKENS = (
    "'s|'t|'re|'ve|'m|'ll|'d",
    "-me|-te|-se|-o|-a|-nos|-vos",
    "-os|-as|-lo|-la|-los|-las",
    "-lhe|-lhes|-no|-na|-nos|-nas",
    " ?\\p{IsHan}",
    " ?\\p{L}+",
    " ?\\p{N}",
    " ?[^\\s\\p{L}\\p{N}]+",
    "\\s+(?!\\S)",
    "\\s+",
)
CORE_TOKENS = ("<PAD>", "<SEQ>", "<BOS>", "<EOS>", "<MASK>")
EXTRA_TOKENS = 100
SPACING = ("Ġ", "Ċ", "#", "-", "_", "=", "*", ".")
# End of fixed values.

#: Pairs that come to the driver for a pass of merges.
PASS = 64
#: Pre-tokens that a task looks at in one step, and distinct ones that it knows at a time.
AT_ONCE, KNOWN = 1 << 19, 500_000

SPECIAL_TOKENS = (*CORE_TOKENS, *(f"<extra_{i}>" for i in range(EXTRA_TOKENS)))
SPACING_TOKENS = tuple(c * 2**i for c in SPACING for i in range(1, 10))


def byte_letters() -> dict[int, str]:
    """A printable letter for each byte: itself where it prints, else the next free one from U+0100 on."""
    out, free = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out[b] = chr(b)
        else:
            out[b] = chr(free)
            free += 1
    return out


_MOVED = {chr(b): c for b, c in byte_letters().items() if chr(b) != c}
_FROM, _TO = "".join(_MOVED), "".join(_MOVED.values())


def byte_encode(text: Column) -> Column:
    return F.translate(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"), _FROM, _TO)


def byte_decode(text: Column) -> Column:
    return F.decode(F.encode(F.translate(text, _TO, _FROM), "ISO-8859-1"), "UTF-8")


def pre_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?U)" + "|".join(PRE_TOKENS)), F.lit(0))


def _pieces_at_once(pieces: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Slices of a list column with about ``AT_ONCE`` items each (one row at least), with the row where each begins."""
    ends = np.cumsum(np.asarray(pieces.value_lengths().fill_null(0), np.int64))
    row, before = 0, 0
    while row < len(pieces):
        to = max(row + 1, int(np.searchsorted(ends, before + AT_ONCE, "right")))
        yield row, pieces.slice(row, to - row)
        row, before = to, int(ends[to - 1])


def token_counts(documents: DataFrame, text: str = "text", least: int = 1) -> DataFrame:
    """token, freq over all documents; counts of the tasks' batches meet in one shuffle of distinct tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part in _pieces_at_once(batch.column("pieces")):
                found = part.flatten().value_counts()
                yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], ["piece", "n"])

    counted = documents.select(pre_tokens(F.col(text)).alias("pieces")).mapInArrow(run, "piece string, n long")
    return counted.groupBy("piece").agg(F.sum("n").alias("freq")).filter(F.col("freq") >= least).select(byte_encode(F.col("piece")).alias("token"), "freq")


def splits(token: Column) -> Column:
    return F.filter(F.split(token, ""), lambda c: c != "")


def pair_counts(tokens: DataFrame) -> DataFrame:
    """left, right, freq of neighbouring symbols. tokens: symbols, freq."""

    def pairs(s: Column) -> Column:
        n = F.greatest(F.lit(0), F.size(s) - 1)
        return F.zip_with(F.slice(s, F.lit(1), n), F.slice(s, F.lit(2), n), lambda x, y: F.struct(x.alias("left"), y.alias("right")))

    found = F.flatten(F.transform(F.array("symbols"), pairs))  # so that the symbols are computed once a row
    return tokens.select(F.explode(found).alias("p"), "freq").groupBy("p.left", "p.right").agg(F.sum("freq").alias("freq"))


def joined(symbols: Column) -> Column:
    """Symbols as one text, each between two marks, so that a merge is a replacement."""
    return F.array_join(F.transform(symbols, lambda x: F.concat(F.lit("\x01"), x, F.lit("\x02"))), "")


def apart(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, "\x02"), lambda x: x != ""), lambda x: F.substring(x, 2, 1 << 30))


def merge_pair(text: Column, left: str, right: str) -> Column:
    """Neighbours left and right put together, from the left and without overlap. text: of ``joined``."""
    return F.replace(text, F.lit(f"\x01{left}\x02\x01{right}\x02"), F.lit(f"\x01{left}{right}\x02"))


def apart_enough(best: list, merges: int) -> list:
    """The first of the most frequent pairs that can be merged in one pass, as one by one: pairs of symbols of their own,
    more frequent than any other pair that has one of their symbols, and so than any that a merge can make."""
    seen, least, out = set(), 0, []
    for p in best:
        if seen & {p["left"], p["right"]}:
            least = p["freq"]
            break
        seen |= {p["left"], p["right"]}
        out.append(p)
    else:
        least = best[-1]["freq"] if len(best) == PASS else 0
    return ([p for p in out if p["freq"] > least] or out[:1])[:merges]


#: Distinct tokens, and letters of them all, that are trained on in one place; more are trained on as a table.
IN_MEMORY, IN_MEMORY_LETTERS = 10_000_000, 100_000_000
#: Symbols whose pairs are counted in a square; with more, a heap holds the pairs of at most so many distinct tokens.
SQUARE, IN_HEAP = 4096, 500_000


def train_merges(tokens: DataFrame, merges: int, every: int = 4, state: str | None = None, in_memory: int = IN_MEMORY) -> list[tuple[str, str, int]]:
    """The merges of a byte-pair vocabulary: the most frequent pair, ties by its letters, again and again. tokens: token, freq.

    The tokens are written once and counted.  Those of a bounded table are folded in memory with pair counts kept up to
    date; a larger one stays a table, written every few passes, and only the best pairs come to the driver.  All ways
    give the same merges.  With ``state``, a folder, merges made before are taken from it, and all are written to it."""
    spark = tokens.sparkSession
    done = load_state(spark, state) if state else []
    if len(done) < merges:
        path = scratch(spark)
        tokens = tokens.select("token", "freq")
        tokens.write.parquet(path)
        tokens = spark.read.schema(tokens.schema).parquet(path)
        size = tokens.agg(F.count("*").alias("tokens"), F.coalesce(F.sum(F.length("token").cast("long")), F.lit(0)).alias("letters")).first()
        few = size["tokens"] <= in_memory and size["letters"] <= IN_MEMORY_LETTERS
        found = _merged_in_square(tokens, merges, done) if few else None
        if found is None:
            found = _merged_in_memory(tokens, merges, done) if size["tokens"] <= min(in_memory, IN_HEAP) else _merged_as_table(tokens, merges, every, done)
        done = found
        if state:
            save_state(spark, state, done)
    return done[:merges]


def save_state(spark, path: str, merges: list) -> None:
    """Merges in order, as a table that is replaced as a whole."""
    rows = [(i, *m) for i, m in enumerate(merges)]
    spark.createDataFrame(rows, "step int, left string, right string, freq long").coalesce(1).write.mode("overwrite").parquet(path)


def load_state(spark, path: str) -> list[tuple[str, str, int]]:
    try:
        rows = spark.read.parquet(path).orderBy("step").collect()  # as many rows as merges
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return []
    return [(r["left"], r["right"], r["freq"]) for r in rows]


def _put_together(symbols: list[str], left: str, right: str) -> list[str]:
    out, i = [], 0
    while i < len(symbols):
        both = i + 1 < len(symbols) and symbols[i] == left and symbols[i + 1] == right
        out.append(left + right if both else symbols[i])
        i += 1 + both
    return out


#: Ends a word, and fills the room that its merges leave.
_END = 0xFFFF


class _Words:
    """Distinct tokens as numbered symbols in one row, each with room of its own, and a square of the counts of all pairs."""

    def __init__(self, symbols: np.ndarray, starts: np.ndarray, freqs: np.ndarray, most: int):
        self.symbols, self.starts, self.freqs = symbols, starts, freqs
        self.most, self.counts = most, np.zeros(most * most, np.int64)
        for at in range(0, len(freqs), 1 << 18):
            self._count(*self._of(np.arange(at, min(len(freqs), at + (1 << 18))))[1:], 1)

    def _of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of some words' symbols, the symbols, and the number in ``words`` of each one's word."""
        room = self.starts[words + 1] - self.starts[words]
        of = np.repeat(np.arange(len(words)), room)
        places = np.arange(len(of)) + np.repeat(self.starts[words] - (np.cumsum(room) - room), room)
        return places, self.symbols[places], np.repeat(self.freqs[words], room)

    def _count(self, symbols: np.ndarray, freqs: np.ndarray, sign: int) -> None:
        at = np.flatnonzero((symbols[:-1] != _END) & (symbols[1:] != _END))
        np.add.at(self.counts, symbols[at].astype(np.int64) * self.most + symbols[at + 1], sign * freqs[at])

    def _pairs(self, symbols: np.ndarray, left: int, right: int) -> np.ndarray:
        """Places of a pair, from the left and without overlap."""
        hits = np.flatnonzero(symbols[:-1] == left)
        hits = hits[symbols[hits + 1] == right]
        if left == right and len(hits):
            first = np.flatnonzero(np.diff(hits, prepend=-2) != 1)
            runs = np.diff(np.append(first, len(hits)))
            hits = hits[(np.arange(len(hits)) - np.repeat(first, runs)) % 2 == 0]
        return hits

    def merge(self, left: int, right: int, both: int) -> None:
        for at in range(0, len(self.symbols), 1 << 23):
            hits = at + self._pairs(self.symbols[at : at + (1 << 23) + 1], left, right)
            words = np.unique(np.searchsorted(self.starts, hits, "right") - 1)
            for k in range(0, len(words), 1 << 18):
                self._merge(words[k : k + (1 << 18)], left, right, both)

    def _merge(self, words: np.ndarray, left: int, right: int, both: int) -> None:
        places, symbols, freqs = self._of(words)
        hits = self._pairs(symbols, left, right)
        if not len(hits):
            return
        self._count(symbols, freqs, -1)
        symbols[hits] = both
        gone = np.zeros(len(symbols), bool)
        gone[hits + 1] = True
        lost = np.cumsum(gone)
        room = self.starts[words + 1] - self.starts[words]
        first = np.cumsum(room) - room
        kept = np.flatnonzero(~gone)
        before = np.repeat(lost[first], room)  # a word's first symbol never goes
        moved = np.full(len(symbols), _END, np.uint16)
        moved[kept - (lost - before)[kept]] = symbols[kept]
        self.symbols[places] = moved
        self._count(moved, freqs, 1)

    def tighten(self) -> None:
        """Take back the room that merges left: one end mark stays for each word."""
        kept = self.symbols != _END
        kept[self.starts[1:] - 1] = True
        self.starts = np.concatenate([np.zeros(1, np.int64), np.cumsum(kept)[self.starts[1:] - 1]])
        self.symbols = self.symbols[kept]


def _merged_in_square(tokens: DataFrame, merges: int, done: list) -> list[tuple[str, str, int]] | None:
    """Merges over arrays of symbols; None where there are too many symbols for a square of pairs."""
    number, known, parts, sizes, freqs = np.zeros(0x110000, np.uint16), np.zeros(0x110000, bool), [], [], []
    names: list[str] = []
    for batch in tokens.select("token", "freq").toArrow().to_batches():
        texts = [t for t in batch.column(0).to_pylist()]
        codes = np.frombuffer(("\0".join(texts) + "\0").encode("utf-32-le"), np.uint32) if texts else np.zeros(0, np.uint32)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(lengths + 1) - 1
        inside = np.ones(len(codes), bool)
        inside[ends] = False
        new = np.unique(codes[inside])
        new = new[~known[new]]
        if len(names) + len(new) + merges > SQUARE:
            return None
        number[new], known[new] = np.arange(len(names), len(names) + len(new)), True
        names += [chr(c) for c in new]
        symbols = number[codes]
        symbols[ends] = _END
        parts.append(symbols)
        sizes.append(lengths + 1)
        freqs.append(batch.column(1).to_numpy(zero_copy_only=False))
    if not parts:
        return list(done)
    of = {name: i for i, name in enumerate(names)}
    words = _Words(np.concatenate(parts), np.concatenate([np.zeros(1, np.int64), np.cumsum(np.concatenate(sizes))]), np.concatenate(freqs), len(names) + merges)
    del parts

    def put(left: str, right: str) -> None:
        if left in of and right in of:
            if left + right not in of:
                of[left + right] = len(names)
                names.append(left + right)
            words.merge(of[left], of[right], of[left + right])

    for left, right, _ in done:
        put(left, right)
    out = list(done)
    while len(out) < merges:
        n = int(words.counts.max())
        if n <= 0:
            break
        best = min((names[i // words.most], names[i % words.most]) for i in np.flatnonzero(words.counts == n).tolist())
        out.append((*best, n))
        put(*best)
        if len(out) % 32 == 0:
            words.tighten()
    return out


def _merged_in_memory(tokens: DataFrame, merges: int, done: list) -> list[tuple[str, str, int]]:
    """A heap of pair counts; a merge touches only the tokens that hold its pair."""
    rows = [(list(r["token"]), r["freq"]) for r in tokens.select("token", "freq").toLocalIterator()]
    words, freqs = [w for w, _ in rows], [f for _, f in rows]
    for left, right, _ in done:
        words = [_put_together(w, left, right) if left in w else w for w in words]
    counts: dict[tuple[str, str], int] = {}
    where: dict[tuple[str, str], set[int]] = {}
    for i, w in enumerate(words):
        for pair in itertools.pairwise(w):
            counts[pair] = counts.get(pair, 0) + freqs[i]
            where.setdefault(pair, set()).add(i)
    heap = [(-n, p) for p, n in counts.items()]
    heapq.heapify(heap)
    out = list(done)
    while len(out) < merges and heap:
        n, pair = heapq.heappop(heap)
        if not n or counts.get(pair, 0) != -n:
            continue
        out.append((*pair, -n))
        changed = set()
        for i in where.pop(pair):
            old, new = words[i], _put_together(words[i], *pair)
            for p in itertools.pairwise(old):
                counts[p] -= freqs[i]
                changed.add(p)
            for p in itertools.pairwise(new):
                counts[p] = counts.get(p, 0) + freqs[i]
                where.setdefault(p, set()).add(i)
                changed.add(p)
            words[i] = new
        for p in changed:
            if counts[p] > 0:
                heapq.heappush(heap, (-counts[p], p))
    return out


def _merged_as_table(tokens: DataFrame, merges: int, every: int, done: list) -> list[tuple[str, str, int]]:
    spark, out, i = tokens.sparkSession, list(done), 0
    now = tokens.select(joined(splits(F.col("token"))).alias("text"), "freq")
    for left, right, _ in done:
        now = now.withColumn("text", merge_pair(F.col("text"), left, right))
    while len(out) < merges:
        if i % every == 0:
            path = scratch(spark)
            now.write.parquet(path)
            now = spark.read.schema(now.schema).parquet(path)
        best = pair_counts(now.select(apart(F.col("text")).alias("symbols"), "freq")).orderBy(F.desc("freq"), "left", "right").limit(PASS).collect()
        if not best:
            break
        for p in apart_enough(best, merges - len(out)):
            out.append((p["left"], p["right"], p["freq"]))
            now = now.withColumn("text", merge_pair(F.col("text"), p["left"], p["right"]))
        i += 1
    return out


def vocabulary(merges: list) -> list[str]:
    """Byte letters, then what each merge made, each once."""
    return list(dict.fromkeys([*byte_letters().values(), *(a + b for a, b, _ in merges)]))


def longest_match(token: str, vocab: set[str], most: int) -> list[str]:
    """Pieces from the left, each the longest of the vocabulary; none if that fails."""
    out, at = [], 0
    while at < len(token):
        for size in range(min(most, len(token) - at), 0, -1):
            if token[at : at + size] in vocab:
                out.append(token[at : at + size])
                at += size
                break
        else:
            return []
    return out


class _Segments:
    """The ids of pieces, each segmented once as long as it is known."""

    def __init__(self, vocab: list[str], known: int):
        self.vocab = {v: i for i, v in enumerate(vocab)}
        self.longest, self.most = max(map(len, self.vocab), default=0), known
        self.letters = [byte_letters()[b] for b in range(256)]
        self.known: dict[str, list[int]] = {}

    def _ids(self, piece: str) -> list[int]:
        token = "".join([self.letters[b] for b in piece.encode()])
        found = longest_match(token, self.vocab, self.longest)
        if token and not found:
            raise ValueError(f"no pieces for {token!r}")
        return [self.vocab[p] for p in found]

    def of(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some pieces, and how many each has."""
        coded = pieces.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.known) + len(distinct) > self.most:
            self.known = {}
        mine = [self.known.get(p) for p in distinct]
        for i, found in enumerate(mine):
            if found is None:
                mine[i] = self.known[distinct[i]] = self._ids(distinct[i])
        size = np.fromiter(map(len, mine), np.int64, len(mine))
        flat = np.fromiter(itertools.chain.from_iterable(mine), np.int32, int(size.sum()))
        first = np.cumsum(size) - size
        which = coded.indices.to_numpy(zero_copy_only=False)
        sizes = size[which]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return flat[np.repeat(first[which] - (ends - sizes), sizes) + np.arange(total)], sizes


def encoded(documents: DataFrame, vocab: list[str], key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, columns to keep, ids of each document; a task segments each distinct pre-token once, as long as it knows it.

    Texts without one are left out.  The vocabulary is a fixed list that goes with the tasks.  A token that cannot be put
    together from it raises."""
    names = list(dict.fromkeys([key, *keep]))
    rows = documents.filter(F.col(text) != "").select(*names, pre_tokens(F.col(text)).alias("_pieces"))  # any other text has pieces
    shared = documents.sparkSession.sparkContext.broadcast(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments = _Segments(shared.value, KNOWN)
        for batch in batches:
            for row, part in _pieces_at_once(batch.column("_pieces")):
                ids, sizes = segments.of(part.flatten())
                sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
                ends = sums[np.concatenate([np.zeros(1, np.int64), np.cumsum(np.asarray(part.value_lengths(), np.int64))])]
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(row, len(part)) for c in names] + [lists], [*names, "ids"])

    fields = [*rows.select(*names).schema.fields, StructField("ids", ArrayType(IntegerType()))]
    return rows.mapInArrow(run, StructType(fields))


_CHARS = lambda t: F.filter(F.split(t, ""), lambda c: c != "")
_ONE = lambda t: F.size(F.array_distinct(_CHARS(t))) == 1
_NO_ALNUM = lambda t: ~t.rlike("[\\p{L}\\p{N}]")
# Rules that name what is wrong with a vocabulary token, in order, with their patterns and limits.
RULES = {
    "too_long": lambda t: F.length(t) > 50,
    "composite_number": lambda t: t.rlike("^\\p{Nd}{2,}$"),
    "symbol_line": lambda t: (F.length(t) >= 5) & _ONE(t) & _NO_ALNUM(t),
    "html_or_code": lambda t: (F.length(t) > 3) & t.rlike("</?[a-z]{2,}[^>]*>|\\\\x[0-9A-Fa-f]{2}|https?://|\\.com"),
    "emoji_string": lambda t: (F.length(t) >= 3) & F.forall(_CHARS(t), lambda c: F.ascii(c) > 10000),
    "repeated_characters": lambda t: (F.length(t) > 4) & _ONE(t),
    "camelcase_noise": lambda t: t.rlike("^[\\x00-\\x7F]*$") & (F.regexp_count(t, F.lit("[A-Z]")) > 2) & (F.regexp_count(t, F.lit("[a-z]")) > 2),
    "excessive_capital": lambda t: (F.length(t) > 3) & (F.upper(t) == t) & (F.lower(t) != t),
    "fake_unicode_esc": lambda t: t.rlike("\\\\u[0-9a-fA-F]{4}|\\\\x[0-9a-fA-F]{2}"),
    "garbage_maths": lambda t: t.rlike("^[+\\-*/=<>^~]{4,}$"),
    "mixed_punct": lambda t: (F.length(t) > 3) & _NO_ALNUM(t) & ~_ONE(t),
    "bad_token_shape": lambda t: t.rlike("^[-_.]{2,}.+[-_.]+$"),
    "repeated_units": lambda t: t.rlike("^(.+)\\1{2,}$"),
}
# End of fixed values.


def suspicious(token: Column, rules=None) -> Column:
    """The first rule that holds, or null."""
    return F.coalesce(*[F.when(rule(token), F.lit(name)) for name, rule in (rules or RULES).items()])


def clean_vocab(vocab: DataFrame, total: int) -> DataFrame:
    """token_id, token: special tokens, then the first of the rest that no rule names, then spacing tokens. vocab: token_id, token."""
    spark = vocab.sparkSession
    room = max(0, total - len(SPECIAL_TOKENS) - len(SPACING_TOKENS))
    kept = vocab.filter(suspicious(F.col("token")).isNull() & ~F.col("token").isin(*SPECIAL_TOKENS, *SPACING_TOKENS)).orderBy("token_id").limit(room)
    first = spark.createDataFrame([(0, i, t) for i, t in enumerate(SPECIAL_TOKENS)], "part int, token_id long, token string")
    last = spark.createDataFrame([(2, i, t) for i, t in enumerate(SPACING_TOKENS)], "part int, token_id long, token string")
    from pyspark.sql import Window

    whole = first.unionByName(kept.select(F.lit(1).alias("part"), F.col("token_id").cast("long"), "token")).unionByName(last)
    return whole.select((F.row_number().over(Window.orderBy("part", "token_id")) - 1).cast("long").alias("token_id"), "token")  # at most ``total`` rows


def windows(tokens: Column, length: int) -> Column:
    """Frames of length + 1 tokens that step by length, so neighbours share one; what is left over goes."""
    n = F.floor((F.size(tokens) - 1) / length)
    frames = F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), n - 1)), lambda i: F.slice(tokens, (i * length + 1).cast("int"), F.lit(length + 1)))
    return F.when(F.size(tokens) > length, frames).otherwise(F.expr("cast(array() as array<array<int>>)"))


def next_tokens(frame: Column) -> Column:
    n = F.size(frame)
    return F.struct(F.slice(frame, F.lit(1), n - 1).alias("x"), F.slice(frame, F.lit(2), n - 1).alias("y"))


def sft_labels(messages: Column, ids: dict[str, int], length: int | None, ignore: int = -100, left: bool = True, final_only: bool = False) -> Column:
    """input_ids, labels, attention_mask of messages (role, tokens): a mark, the tokens and an end id for each turn.

    Labels stand one place before the id they ask for, on the assistant's tokens and end ids alone.
    Without a length nothing is cut and nothing padded."""
    roles = F.create_map(*[F.lit(x) for r in ("user", "assistant", "system") for x in (r, ids[r])])
    last = F.size(messages) - 1

    def turn(m: Column, i: Column) -> Column:
        own = (m["role"] == "assistant") & ((i == last) if final_only else F.lit(True))
        body = F.concat(F.transform(m["tokens"], lambda t: F.struct(t.alias("id"), own.alias("on"))), F.array(F.struct(F.lit(ids["eos"]).alias("id"), own.alias("on"))))
        return F.concat(F.array(F.struct(F.element_at(roles, m["role"]).alias("id"), F.lit(False).alias("on"))), body)

    flat = F.flatten(F.transform(messages, turn))
    after = F.concat(F.slice(flat, F.lit(2), F.greatest(F.lit(0), F.size(flat) - 1)), F.array(F.struct(F.lit(ignore).alias("id"), F.lit(False).alias("on"))))
    labels = F.transform(after, lambda a: F.when(a["on"], a["id"]).otherwise(F.lit(ignore)))
    inputs = F.transform(flat, lambda a: a["id"])

    def fitted(x: Column, fill: int) -> Column:
        if length is None:
            return x
        cut = F.when(F.size(x) > length, F.slice(x, F.lit(-length) if left else F.lit(1), F.lit(length))).otherwise(x)
        pad = F.array_repeat(F.lit(fill), F.greatest(F.lit(0), F.lit(length) - F.size(cut)))
        return F.concat(pad, cut) if left else F.concat(cut, pad)

    whole = fitted(inputs, ids["pad"])
    return F.struct(whole.alias("input_ids"), fitted(labels, ignore).alias("labels"), F.transform(whole, lambda t: F.when(t == ids["pad"], 0).otherwise(1)).alias("attention_mask"))


def in_range(tokens: Column, size: int) -> Column:
    """The ids; one below 0 or not below ``size`` raises."""
    bad = F.exists(tokens, lambda t: (t < 0) | (t >= size))
    return F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit(f"an id is not in [0, {size})")).cast("array<int>")).otherwise(tokens)


def prompt_ids(messages: Column, ids: dict[str, int]) -> Column:
    """Ids of a dialogue that asks for an answer: the role's mark, the tokens and an end id for each turn; the last turn
    ends with the assistant's mark. messages: role, tokens."""
    roles = F.create_map(*[F.lit(x) for r in ("user", "assistant", "system") for x in (r, ids[r])])
    last = F.size(messages) - 1

    def turn(m: Column, i: Column) -> Column:
        end = F.when(i == last, F.lit(ids["assistant"])).otherwise(F.lit(ids["eos"]))
        return F.concat(F.array(F.element_at(roles, m["role"])), m["tokens"], F.array(end))

    return F.flatten(F.transform(messages, turn))


def resolve(vocab: DataFrame, names: dict[str, str]) -> dict[str, int]:
    """The ids of named special tokens. vocab: token_id, token. names: from name to token; a token that is not there raises."""
    found = {r["token"]: r["token_id"] for r in vocab.filter(F.col("token").isin(*names.values())).collect()}  # a row for each name
    lost = sorted(set(names.values()) - set(found))
    if lost:
        raise KeyError(f"not in the vocabulary: {lost}")
    return {name: found[token] for name, token in names.items()}


def causal_masks(segments: np.ndarray) -> np.ndarray:
    """``causal_mask`` of each row of a batch, with an axis for heads."""
    n = segments.shape[1]
    return np.stack([causal_mask(x) for x in segments])[:, None] if len(segments) else np.zeros((0, 1, n, n), bool)


def causal_mask(segments: np.ndarray) -> np.ndarray:
    """True where place i may see place j: not later, of the same segment, and no padding."""
    at = np.arange(len(segments))
    return (at[None, :] <= at[:, None]) & (segments[None, :] == segments[:, None]) & (segments[:, None] != -1)
