"""Deterministic answer metrics: each gives struct<passed, details>."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import batched

RESULT = "struct<passed:boolean,details:map<string,string>>"


def result(passed: Column, **details: Column) -> Column:
    pairs = [x for k, v in details.items() for x in (F.lit(k), v.cast("string"))]
    found = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()) if pairs else F.expr("cast(map() as map<string,string>)")
    return F.struct(passed.alias("passed"), found.alias("details"))


def strip_trailing_tags(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "(<[^>\\s]+>\\s*)+$", ""))


def normalize(text: Column) -> Column:
    """Lower case, white space squeezed, final marks dropped."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(text, "^\\s+|\\s+$", "")), "\\s+", " "), "[.!?]+$", "")


def stop_token(answer: Column, token: Column) -> Column:
    """Whether the raw answer ends with the token; null, with the reason, where no token is expected."""
    return result(F.endswith(F.regexp_replace(answer, "\\s+$", ""), token), expected_token=token)


def contains_expected(answer: Column, expected: Column) -> Column:
    low = F.lower(answer)
    matched = F.get(F.filter(expected, lambda e: F.contains(low, F.lower(e))), F.lit(0))
    return result(matched.isNotNull(), matched=matched)


def _listed_items(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "(?i),|\\be\\b|\\band\\b"), lambda s: F.trim(s) != ""))


def constraint(answer: Column, kind: Column, value: Column) -> Column:
    """The constraint types of instructions; an unknown one raises."""
    text = F.regexp_replace(strip_trailing_tags(answer), "[.!? ]+$", "")
    parts = F.filter(F.split(text, "\\s+"), lambda w: w != "")
    letters = F.regexp_replace(text, "[^\\p{L}]", "")
    count = F.try_to_number(value, F.lit("999999")).cast("int") if hasattr(F, "try_to_number") else value.cast("int")
    passed = (
        F.when(kind == "single_number", (F.size(parts) == 1) & F.get(parts, F.lit(0)).rlike("^-?[0-9]+$"))
        .when(kind == "lowercase", (letters != "") & (letters == F.lower(letters)))
        .when(kind == "uppercase", (letters != "") & (letters == F.upper(letters)))
        .when(kind == "one_word", F.size(parts) == 1)
        .when(kind == "yes_no", F.lower(text).isin("yes", "no", "sim", "nao", "não"))
        .when(kind == "max_words", F.size(parts) <= count)
        .when(kind == "exact_item_count", _listed_items(text) == count)
        .when(kind == "sentence_count", F.size(F.filter(F.split(text, "[.!?]+"), lambda s: F.trim(s) != "")) == count)
        .when(kind == "exact_match", text == F.regexp_replace(value, "[.!? ]+$", ""))
        .when(kind == "reverse_word", F.lower(text) == F.lower(F.reverse(F.trim(value))))
        .otherwise(F.raise_error(F.concat(F.lit("unknown constraint_type: "), kind)).cast("boolean"))
    )
    return result(passed, constraint_type=kind)


def loop_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[\\p{L}\\p{N}_]+(?:['’][\\p{L}\\p{N}_]+)?"), F.lit(0))


def find_loop(tokens: list[str]) -> tuple[int, int, int]:
    """Size, start and repeats of the longest phrase that follows itself, the leftmost of them; (0, 0, 0) if none.

    Phrases of one or two words count from three in a row, longer ones from two.  For a phrase size, runs of places
    whose word equals the one a phrase further give every repeat in one pass."""
    n = len(tokens)
    for size in range(n // 2, 0, -1):
        need = (3 if size <= 2 else 2) - 1
        run = 0
        for i in range(n - size):
            run = run + 1 if tokens[i] == tokens[i + size] else 0
            if run == need * size:
                start = i - run + 1
                j = i + 1
                while j < n - size and tokens[j] == tokens[j + size]:
                    j += 1
                return size, start, (j - start) // size + 1
    return 0, 0, 0


@batched("struct<phrase:string,repetitions:int,ngram_size:int>")
def loops(tokens: pd.Series) -> pd.DataFrame:
    rows = []
    for t in tokens:
        t = [] if t is None else list(t)
        size, start, n = find_loop(t)
        rows.append((" ".join(t[start : start + size]), n, size))
    return pd.DataFrame(rows, columns=["phrase", "repetitions", "ngram_size"])


def repetition(answer: Column) -> Column:
    found = loops(loop_tokens(answer))
    some = found["ngram_size"] > 0
    return result(~some, phrase=F.when(some, found["phrase"]), repetitions=F.when(some, found["repetitions"]), ngram_size=F.when(some, found["ngram_size"]))


def lowercase_words(answer: Column) -> Column:
    every = F.regexp_extract_all(strip_trailing_tags(answer), F.lit("\\p{L}+"), F.lit(0))
    return F.array_distinct(F.filter(every, lambda w: (F.length(w) >= 2) & (w == F.lower(w))))


def coherence(answer: Column, unknown: Column, unknown_elsewhere: Column) -> Column:
    """Near-empty answers fail; so do words unknown to the language's dictionary.

    unknown: the answer's lower-case words missing from its dictionary; unknown_elsewhere: those also missing from the
    other language's.  Null: no dictionary, which passes."""
    empty = ~strip_trailing_tags(answer).rlike("[\\p{L}\\p{N}]")
    reason = (
        F.when(empty, "near_empty")
        .when(unknown.isNull(), "no_dictionary_for_language")
        .when(F.size(unknown_elsewhere) > 0, "invented_words")
        .when(F.size(unknown) > 0, "wrong_language")
    )
    words = F.when(~empty & (F.size(unknown) > 0), F.array_join(F.array_sort(F.when(F.size(unknown_elsewhere) > 0, unknown_elsewhere).otherwise(unknown)), ","))
    return result(~empty & (unknown.isNull() | (F.size(unknown) == 0)), reason=reason, words=words)


def not_empty(answer: Column) -> Column:
    return result(strip_trailing_tags(answer).rlike("[\\p{L}\\p{N}]"))


#: Metric and the columns that it needs beside the answer.
METRICS: dict[str, tuple[Callable, tuple[str, ...]]] = {
    "expected_stop_token": (stop_token, ("expected_token",)),
    "contains_expected": (contains_expected, ("expected",)),
    "constraint_satisfied": (constraint, ("constraint_type",)),
    "repetition": (repetition, ()),
    "coherence": (coherence, ()),
    "not_empty": (not_empty, ()),
}
#: Columns that a metric takes whether they are null or not.
OPTIONAL = {"constraint_satisfied": ("constraint_value",), "coherence": ("unknown", "unknown_elsewhere")}


def register(name: str, metric: Callable, needs: tuple[str, ...] = ()) -> None:
    """Add a metric: a function of the answer and the needed columns that gives a ``result``."""
    if name in METRICS:
        raise ValueError(f"metric {name!r} is there already")
    METRICS[name] = (metric, needs)


# Number words, and patterns of instructions in the order they are tried.
NUMBER_WORDS = {
    "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "single": 1,
    "um": 1, "uma": 1, "dois": 2, "duas": 2, "tres": 3, "três": 3, "quatro": 4, "cinco": 5, "seis": 6, "sete": 7, "oito": 8, "nove": 9, "dez": 10,
}
INSTRUCTIONS = (
    ("single_number", "\\bsingle number\\b|\\bum n[uú]mero\\b|\\bum [uú]nico n[uú]mero\\b", None),
    ("lowercase", "\\blowercase\\b|\\bmin[uú]sculas\\b", None),
    ("one_word", "\\bone[\\s-]word\\b|\\buma palavra\\b", None),
    ("yes_no", "\\byes or no\\b|\\bsim ou n[aã]o\\b", None),
    ("uppercase", "\\ball uppercase\\b|\\bcapital letters\\b|\\bmai[uú]sculas\\b", None),
    ("reverse_word", "\\bbackwards\\b|\\bde tr[aá]s para frente\\b", "quote"),
    ("exact_match", "\\brepeat exactly\\b|\\brepita exatamente\\b|\\brepeat the word\\b|\\bsay the word\\b.{0,15}back\\b|\\brepita a palavra\\b|\\bdiga a palavra\\b.{0,20}volta\\b", "quote"),
    ("max_words", "\\bno more than \\w+ words\\b|\\bat most \\w+ words\\b|\\bfewer than \\w+ words\\b|\\bunder \\w+ words\\b|\\b\\w+ words? or fewer\\b|\\bwords? maximum\\b|\\bkeep.{0,15}\\w+ words\\b|\\bm[aá]ximo.{0,10}\\w+ palavras\\b|\\baté \\w+ palavras\\b", "count"),
    ("exact_item_count", "\\bexactly \\d+\\b|\\blist exactly\\b|\\bname exactly\\b|\\bgive exactly\\b|\\bmention exactly\\b|\\bliste exatamente\\b|\\bnomeie exatamente\\b|\\bmencione exatamente\\b|\\bcite exatamente\\b|\\bd[êe] exatamente\\b|\\b(list|name|cite|give( me)?)\\s+(a\\s+)?(\\d+|one|two|three|four|five|six|seven|eight|nine|ten|single)\\b|\\b(liste|cite)\\s+(um|uma|dois|duas|tr[eê]s|quatro|cinco|seis|sete|oito|nove|dez|\\d+)\\b|\\bd[êe]\\s+(um|uma|\\d+)\\s+exempl", "count"),
    ("sentence_count", "\\bone sentence\\b|\\bsingle sentence\\b|\\buma frase\\b|\\buma [uú]nica frase\\b", "count"),
)
# End of fixed values.


#: Constraint types that say nothing without their value.
NEEDS_VALUE = tuple(name for name, _, value in INSTRUCTIONS if value)


def extract_count(text: Column) -> Column:
    """The first number in digits, else the number word that comes first."""
    digits = F.regexp_extract(text, "(?U)\\b(\\d+)\\b", 1)
    word = F.lower(F.regexp_extract(text, "(?iU)\\b(" + "|".join(NUMBER_WORDS) + ")\\b", 1))
    by_word = F.create_map(*[F.lit(x) for pair in NUMBER_WORDS.items() for x in pair])
    return F.when(digits != "", digits.cast("int")).otherwise(F.try_element_at(by_word, word))


def infer_constraint(text: Column) -> Column:
    """struct<constraint_type, constraint_value> of an instruction, null where no pattern holds."""
    quote = F.nullif(F.regexp_extract(text, "['\"]([^'\"]+)['\"]", 1), F.lit(""))
    out = F.lit(None)
    for name, pattern, value in reversed(INSTRUCTIONS):
        count = extract_count(text)
        if name == "sentence_count":
            count = F.coalesce(count, F.lit(1))
        found = {"quote": quote, "count": count.cast("string"), None: F.lit(None).cast("string")}[value]
        out = F.when(text.rlike("(?iU)" + pattern), F.struct(F.lit(name).alias("constraint_type"), found.alias("constraint_value"))).otherwise(out)
    return out


def json_objects(rows: DataFrame, text: str) -> DataFrame:
    """The rows with each object of the JSON array that a text holds, as text in column ``object``; code fences are taken off."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(text, "^\\s*```[a-zA-Z]*\\s*", ""), "\\s*```\\s*$", ""))
    items = F.from_json(F.when(bare.rlike("^\\s*\\["), bare), "array<string>")
    return rows.withColumn("object", F.explode(items)).filter(F.trim("object").startswith("{"))
