"""Secret scans with SQL functions alone.

Patterns find assignments, access keys and hex runs.  Beside them, candidate
strings (long runs of key characters with a letter and a digit) are measured:
a window slides over a candidate, the counts of its characters change by the
one that enters and the one that leaves, and the Shannon entropy follows from
them.  A candidate belongs to the narrowest class of characters that holds it
(hex, alnum, base64), and each class has its own threshold.  The windows above
it, from the first to the last, are a span of kind "entropy", unless an
allow-list pattern matches the candidate or a span of the patterns meets it.

Spans are in code points, the end exclusive, and hold the whole match.  Places
are sums of lengths in steps over blocks of blocks of matches, so work follows
the text and its matches and not their square; the counts of a window are a short
text of one character for each character of the alphabet.

Cases: a null or empty text has no spans; a very long text is scanned whole;
repeated rows each give a row; an empty table gives no rows; further columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tables as T

ASSIGN = "(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
#: A run of the same characters matches as a whole, so a run that is long enough is asked for at once; a run that is too
#: short holds no other match.  An assignment has to be matched before its length counts, as it may hold the next one.
ACCESS, HEX = "AKIA[A-Z0-9]{14,}", "[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "entropy")
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Bits a character, by class of characters; the narrowest first.
CLASSES = {"hex": ("^[0-9A-Fa-f]+$", 3.0), "alnum": ("^[A-Za-z0-9]+$", 3.6), "base64": ("^[A-Za-z0-9+/_=-]+$", 3.7)}
#: UUIDs, repeats of one character, examples and placeholders.
ALLOWED = ("^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$", "(.)\\1{9}", "(?i)(example|sample|dummy|placeholder|changeme)")
BLOCK = 64
_FIRST, _LAST = ord("+"), ord("z")
_ZERO = ord("A")


def _let(value: Column, f) -> Column:
    """f of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _blocks(values: Column) -> Column:
    """An array in blocks."""

    def cut(x: Column) -> Column:
        n = F.ceil(F.size(x) / BLOCK).cast("int")
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.slice(x, k * BLOCK + 1, F.lit(BLOCK)))).otherwise(F.array(x))

    return _let(values, cut)


def _starts(sizes: Column, levels: int = 3) -> Column:
    """The sum of all sizes before each, by blocks: what is copied grows with the array times a block."""

    def within(block: Column, base: Column) -> Column:
        zero = F.struct(base.alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
        step = lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
        return F.aggregate(block, zero, step, lambda s: s["out"])

    if levels == 1:
        return within(sizes, F.lit(0))
    total = lambda b: F.aggregate(b, F.lit(0), lambda a, n: a + n)
    return _let(_blocks(sizes), lambda blocks: F.flatten(F.zip_with(blocks, _starts(F.transform(blocks, total), levels - 1), within)))


def _matches(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """Matches in order with their places, from the lengths of the pieces between them."""
    none = F.expr("cast(array() as array<struct<start:int,kind:int,end:int,hit:string>>)")

    def placed(hits: Column) -> Column:
        pieces = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits))
        both = F.zip_with(pieces, hits, lambda p, h: F.length(p) + F.length(h))
        before = F.zip_with(_starts(both), pieces, lambda at, p: at + F.length(p))
        span = lambda at, h: F.struct(at.alias("start"), F.lit(kind).alias("kind"), (at + F.length(h)).alias("end"), h.alias("hit"))
        return F.zip_with(before, hits, span)

    found = _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)
    if keep is not None:
        found = F.filter(found, lambda x: keep(x["hit"]))
    return F.when(text.rlike(pattern), found).otherwise(none)


def _meets(spans: Column, start: Column, end: Column) -> Column:
    """Whether one of sorted disjoint spans meets [start, end): the first that ends after start, found by halving."""

    def step(s: Column, _: Column) -> Column:
        mid = F.floor((s["low"] + s["high"]) / 2).cast("int")
        done, before = s["low"] >= s["high"], F.get(spans, mid)["end"] <= start
        return F.struct(F.when(~done & before, mid + 1).otherwise(s["low"]).alias("low"), F.when(done | before, s["high"]).otherwise(mid).alias("high"))

    zero = F.struct(F.lit(0).alias("low"), F.size(spans).alias("high"))
    rounds = F.sequence(F.lit(1), F.ceil(F.log2(F.size(spans) + 1.0)).cast("int") + 1)
    first = F.aggregate(rounds, zero, step, lambda s: s["low"])
    return (F.size(spans) > 0) & F.coalesce(F.get(spans, first)["start"] < end, F.lit(False))


def _entropy_span(text: Column, window: int) -> Column:
    """first and last start of the windows whose entropy reaches the class's threshold; null if none does."""
    term = lambda n: F.when(n > 1, n * F.log2(n.cast("double"))).otherwise(F.lit(0.0))
    least = F.lit(99.0)
    for pattern, bits in reversed(CLASSES.values()):
        least = F.when(text.rlike(pattern), F.lit(float(bits))).otherwise(least)

    def measured(letters: Column, limit: Column) -> Column:
        place = lambda i: F.ascii(F.get(letters, i - 1)) - (_FIRST - 1)
        count = lambda counts, at: F.ascii(F.substring(counts, at, F.lit(1))) - _ZERO
        put = lambda counts, at, n: F.overlay(counts, F.chr(n + _ZERO), at)
        zero = F.struct(F.lit(chr(_ZERO) * (_LAST - _FIRST + 1)).alias("counts"), F.lit(0.0).alias("sum"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))

        def step(s: Column, i: Column) -> Column:
            # the one that leaves goes first, so that a window of one character counts right
            leaving = i > window
            out = F.when(leaving, place(i - window))
            n_out = count(s["counts"], out)
            less = F.when(leaving, put(s["counts"], out, n_out - 1)).otherwise(s["counts"])
            rest = s["sum"] + F.when(leaving, term(n_out - 1) - term(n_out)).otherwise(F.lit(0.0))

            def entered(x: Column) -> Column:
                at = place(i)
                n_in = count(x["counts"], at)
                total = x["sum"] + term(n_in + 1) - term(n_in)
                above = (i >= window) & (F.log2(F.lit(float(window))) - total / window >= limit)
                return F.struct(
                    put(x["counts"], at, n_in + 1).alias("counts"),
                    total.alias("sum"),
                    F.when(above & (s["first"] < 0), i - window).otherwise(s["first"]).alias("first"),
                    F.when(above, i - window).otherwise(s["last"]).alias("last"),
                )

            return _let(F.struct(less.alias("counts"), rest.alias("sum")), entered)

        done = lambda s: F.when(s["first"] >= 0, F.struct(s["first"].alias("first"), s["last"].alias("last")))
        return F.aggregate(F.sequence(F.lit(1), F.size(letters)), zero, step, done)

    inputs = F.struct(F.filter(F.split(text, ""), lambda c: c != "").alias("letters"), least.alias("limit"))
    return _let(inputs, lambda x: measured(x["letters"], x["limit"]))


def secrets(documents: DataFrame, window: int = WINDOW, allowed=ALLOWED) -> DataFrame:
    """doc_id, base and added spans (arrays of start, kind as index into KINDS, end), ordered by start and kind."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = docs.select(
        "doc_id",
        _matches(F.col("text"), ASSIGN, 0, lambda x: F.length(F.regexp_extract(x, ASSIGN, 2)) >= 12).alias("assign"),
        _matches(F.col("text"), ACCESS, 1).alias("access"),
        _matches(F.col("text"), HEX, 2).alias("hex"),
        _matches(F.col("text"), CANDIDATE, 3, lambda x: x.rlike("[0-9]") & x.rlike("[A-Za-z]") & ~_any(x, allowed)).alias("candidates"),
    )
    bare = lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))
    base = F.array_sort(F.concat(*[F.transform(k, bare) for k in ("assign", "access", "hex")]))
    kinds = ("assign", "access", "hex")
    new = F.filter("candidates", lambda c: ~(_meets(F.col("assign"), c["start"], c["end"]) | _meets(F.col("access"), c["start"], c["end"]) | _meets(F.col("hex"), c["start"], c["end"])))
    found = found.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in kinds], base.alias("base"), new.alias("new"))
    measured = F.transform("new", lambda c: F.struct(c["start"].alias("start"), _entropy_span(c["hit"], window).alias("at")))
    added = F.transform(
        F.filter(measured, lambda x: x["at"].isNotNull()),
        lambda x: F.struct((x["start"] + x["at"]["first"]).alias("start"), F.lit(3).alias("kind"), (x["start"] + x["at"]["last"] + window).alias("end")),
    )
    return found.select("doc_id", *[f"n_{k}" for k in kinds], "base", added.alias("added"))


def _any(x: Column, patterns) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | x.rlike(p)
    return out


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def op2_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = secrets(T.read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_assign",
        "n_access",
        "n_hex",
        F.sha2(F.encode(joined(F.col("base")), "UTF-8"), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat("base", "added"))).alias("spans"),
        F.size("added").cast("long").alias("n_entropy"),
    )
