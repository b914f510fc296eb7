"""Answer metrics and benchmark summaries over the conversations.

An answer is the last turn of a dialogue, dressed so that every metric and constraint has rows that pass and rows that
fail; which dress a dialogue has follows from conv_id.  The manifest is written by hand, as manifests are."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers as A
from ..operators import dialogues as D
from ..operators import evaluation as E
from .base import literal, query, table
from .dialogues import ROWS, rows

#: Constraint of a dialogue by conv_id % 11; the last has none.
KINDS = ["single_number", "lowercase", "uppercase", "one_word", "yes_no", "max_words", "exact_item_count", "sentence_count", "exact_match", "reverse_word"]
MANIFEST = [
    ("turn_taking", "expected_stop_token", "gate", []),
    ("turn_taking", "contains_expected", "diagnostic", ["hi"]),
    ("knowledge_completion", "contains_expected", "gate", []),
    ("instruction_following", "constraint_satisfied", "gate", []),
    ("instruction_following", "expected_stop_token", "diagnostic", []),
    ("uncertainty", "contains_expected", "gate", ["not sure", "não tenho certeza"]),
    ("uncertainty", "not_empty", "gate", []),
]
def answers(spark, sf_dir):
    """id, category, language, answer, expected_any, expected_token, constraint_type, constraint_value."""
    r = rows(spark, sf_dir).filter(F.size("messages") >= 2)
    last, k = F.try_element_at("messages", F.lit(-1))["content"], F.col("conv_id")
    first = F.regexp_extract(last, "[A-Za-z]+", 0)
    body = (
        F.when(k % 11 == 0, F.when(k % 2 == 0, F.concat(k, F.lit("."))).otherwise("twenty six"))
        .when(k % 11 == 1, F.when(k % 2 == 0, F.lower(first)).otherwise(first))
        .when(k % 11 == 2, F.when(k % 2 == 0, F.upper(first)).otherwise(first))
        .when(k % 11 == 3, F.when(k % 2 == 0, first).otherwise(F.concat(first, F.lit(" "), first)))
        .when(k % 11 == 4, F.when(k % 2 == 0, F.lit("Yes.")).otherwise("Maybe."))
        .when(k % 11 == 6, F.when(k % 2 == 0, F.lit("apple, banana and orange")).otherwise("apple, banana"))
        .when(k % 11 == 9, F.when(k % 2 == 0, F.reverse(first)).otherwise(first))
        .otherwise(last)
    )
    value = F.when(k % 11 == 5, "30").when(k % 11 == 6, "3").when(k % 11 == 7, "4").when(k % 11 == 8, F.when(k % 2 == 0, last).otherwise("else")).when(k % 11 == 9, first)
    return r.select(
        F.concat(F.lit("a"), k).alias("id"),
        "category",
        "language",
        F.concat(body, F.when(k % 4 == 0, F.lit("")).otherwise("<EOS>")).alias("answer"),
        F.when(k % 3 == 0, F.array(F.lower(first), F.lit("q"))).when(k % 3 == 1, F.array(F.lit("no such words"))).otherwise(F.expr("cast(array() as array<string>)")).alias("expected_any"),
        F.lit("<EOS>").alias("expected_token"),
        F.get(F.array(*[F.lit(x) for x in KINDS]), (k % 11).cast("int")).alias("constraint_type"),
        value.alias("constraint_value"),
    )


def manifest(spark):
    return spark.createDataFrame(MANIFEST, "category string, metric string, role string, expected_any array<string>")


def evaluated(spark, sf_dir):
    return E.evaluated(answers(spark, sf_dir), manifest(spark))


def steps(spark, sf_dir):
    """step, category, pass_rate: dialogues dealt to three checkpoints."""
    step = ((F.substring("id", 2, 18).cast("long") % 3) + 1) * 100
    return evaluated(spark, sf_dir).groupBy(step.alias("step"), "category").agg(F.bround(F.count_if("passed") / F.count("*"), 4).alias("pass_rate"))


def _v(x):
    if x is None:
        return "NULL"
    if isinstance(x, list):
        return "[" + ", ".join(map(literal, x)) + "]::VARCHAR[]"
    return literal(x) if isinstance(x, str) else str(x)


def _values(found):
    return ", ".join("(" + ", ".join(map(_v, r)) + ")" for r in found)


_FIRST = "regexp_extract(texts[-1], '[A-Za-z]+', 0)"
_EVEN = "CASE WHEN conv_id % 2 = 0 THEN {} ELSE {} END"
_ANSWERS = f"""{ROWS}, a AS (SELECT 'a' || conv_id AS id, conv_id, category, language, CASE conv_id % 11 WHEN 0 THEN {_EVEN.format("conv_id || '.'", "'twenty six'")} WHEN 1 THEN {_EVEN.format(f"lower({_FIRST})", _FIRST)} WHEN 2 THEN {_EVEN.format(f"upper({_FIRST})", _FIRST)}
 WHEN 3 THEN {_EVEN.format(_FIRST, f"{_FIRST} || ' ' || {_FIRST}")} WHEN 4 THEN {_EVEN.format("'Yes.'", "'Maybe.'")} WHEN 6 THEN {_EVEN.format("'apple, banana and orange'", "'apple, banana'")} WHEN 9 THEN {_EVEN.format(f"reverse({_FIRST})", _FIRST)} ELSE texts[-1] END || CASE WHEN conv_id % 4 = 0 THEN '' ELSE '<EOS>' END AS answer,
 CASE conv_id % 3 WHEN 0 THEN [lower({_FIRST}), 'q'] WHEN 1 THEN ['no such words'] ELSE []::VARCHAR[] END AS expected_any, '<EOS>' AS expected_token, [{', '.join(map(literal, KINDS))}][conv_id % 11 + 1] AS constraint_type,
 CASE conv_id % 11 WHEN 5 THEN '30' WHEN 6 THEN '3' WHEN 7 THEN '4' WHEN 8 THEN {_EVEN.format('texts[-1]', "'else'")} WHEN 9 THEN {_FIRST} END AS constraint_value FROM rws WHERE n >= 2)"""
_M = f"m(category, metric, role, shared) AS (VALUES {_values(MANIFEST)})"
_BARE = "regexp_replace(trim(regexp_replace(answer, '(<[^>\\s]+>\\s*)+$', '')), '[.!? ]+$', '')"
_PARTS = "list_filter(regexp_split_to_array(t, '\\s+'), lambda w: w <> '')"
_LETTERS = "regexp_replace(t, '[^\\p{L}]', '', 'g')"
_CONSTRAINT = f"""CASE constraint_type WHEN 'single_number' THEN len({_PARTS}) = 1 AND regexp_matches({_PARTS}[1], '^-?[0-9]+$')
 WHEN 'lowercase' THEN {_LETTERS} <> '' AND {_LETTERS} = lower({_LETTERS}) WHEN 'uppercase' THEN {_LETTERS} <> '' AND {_LETTERS} = upper({_LETTERS})
 WHEN 'one_word' THEN len({_PARTS}) = 1 WHEN 'yes_no' THEN lower(t) IN ('yes', 'no', 'sim', 'nao', 'não') WHEN 'max_words' THEN len({_PARTS}) <= TRY_CAST(constraint_value AS INT)
 WHEN 'exact_item_count' THEN len(list_filter(regexp_split_to_array(t, '(?i),|\\be\\b|\\band\\b'), lambda x: trim(x) <> '')) = TRY_CAST(constraint_value AS INT)
 WHEN 'sentence_count' THEN len(list_filter(regexp_split_to_array(t, '[.!?]+'), lambda x: trim(x) <> '')) = TRY_CAST(constraint_value AS INT)
 WHEN 'exact_match' THEN t = regexp_replace(constraint_value, '[.!? ]+$', '') WHEN 'reverse_word' THEN lower(t) = lower(reverse(trim(constraint_value))) END"""


@query("m_stop_token", f"WITH {ROWS} SELECT conv_id, ends_with(rtrim(texts[-1]), '.') AS passed FROM rws")
def m_stop_token(spark, sf_dir):
    return rows(spark, sf_dir).select("conv_id", A.stop_token(F.try_element_at("messages", F.lit(-1))["content"], F.lit("."))["passed"].alias("passed"))


@query("m_contains", f"WITH {_ANSWERS} SELECT id, list_filter(expected_any, lambda e: contains(lower(answer), lower(e)))[1] AS matched FROM a")
def m_contains(spark, sf_dir):
    return answers(spark, sf_dir).select("id", F.try_element_at(A.contains_expected(F.col("answer"), F.col("expected_any"))["details"], F.lit("matched")).alias("matched"))


@query("m_constraint", f"WITH {_ANSWERS} SELECT id, constraint_type, {_CONSTRAINT} AS passed FROM (SELECT *, {_BARE} AS t FROM a WHERE constraint_type IS NOT NULL)")
def m_constraint(spark, sf_dir):
    a = answers(spark, sf_dir).filter("constraint_type is not null")
    return a.select("id", "constraint_type", A.constraint(F.col("answer"), F.col("constraint_type"), F.col("constraint_value"))["passed"].alias("passed"))


@query("m_repetition")
def m_repetition(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    return turns.select("conv_id", "turn", A.repetition(F.col("text")).alias("r")).select("conv_id", "turn", "r.passed", F.try_element_at("r.details", F.lit("phrase")).alias("phrase"))


def _known(spark, sf_dir, languages, least=3):
    """The lower-case words that at least three documents of some languages have."""
    docs = table(spark, sf_dir, "documents").filter(F.col("lang").isin(*languages)).select(F.explode(A.lowercase_words(F.col("text"))).alias("word"))
    return docs.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("word")


def checked_words(spark, sf_dir):
    """conv_id, turn, text, unknown, unknown_elsewhere of assistant turns: words that the dictionary of the turn's language
    lacks, and those of them that the other's lacks.  English and all others are the two dictionaries; even dialogues count as English."""
    turns = table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    words = turns.select("conv_id", "turn", "text", (F.col("conv_id") % 2 == 0).alias("en"), F.explode_outer(A.lowercase_words(F.col("text"))).alias("word"))
    en, other = (_known(spark, sf_dir, x).withColumn(name, F.lit(True)) for x, name in ((["en"], "in_en"), (["de", "es", "fr", "pt"], "in_other")))
    found = words.join(en, "word", "left").join(other, "word", "left")
    own, else_ = F.when(F.col("en"), F.col("in_en")).otherwise(F.col("in_other")), F.when(F.col("en"), F.col("in_other")).otherwise(F.col("in_en"))
    return found.groupBy("conv_id", "turn").agg(
        F.first("text").alias("text"), F.array_sort(F.collect_set(F.when(own.isNull(), F.col("word")))).alias("unknown"), F.array_sort(F.collect_set(F.when(own.isNull() & else_.isNull(), F.col("word")))).alias("unknown_elsewhere")
    )


_LOWER = "list_distinct(list_filter(regexp_extract_all(trim(regexp_replace(text, '(<[^>\\s]+>\\s*)+$', '')), '\\p{L}+'), lambda w: length(w) >= 2 AND w = lower(w)))"


@query(
    "m_coherence",
    f"""WITH dw AS (SELECT lang = 'en' AS en, unnest({_LOWER}) AS word FROM documents WHERE lang IN ('en', 'de', 'es', 'fr', 'pt')), d AS (SELECT en, word FROM dw GROUP BY ALL HAVING count(*) >= 3),
 t AS (SELECT conv_id, turn, conv_id % 2 = 0 AS en, text, {_LOWER} AS words FROM conversations WHERE role = 'assistant'), w AS (SELECT conv_id, turn, en, unnest(words) AS word FROM t),
 u AS (SELECT w.conv_id, w.turn, count(*) FILTER (a.word IS NULL) AS unknown, count(*) FILTER (a.word IS NULL AND b.word IS NULL) AS invented FROM w LEFT JOIN d a ON a.word = w.word AND a.en = w.en LEFT JOIN d b ON b.word = w.word AND b.en <> w.en GROUP BY ALL)
 SELECT conv_id, turn, regexp_matches(text, '[\\p{{L}}\\p{{N}}]') AND coalesce(unknown, 0) = 0 AS passed, CASE WHEN NOT regexp_matches(text, '[\\p{{L}}\\p{{N}}]') THEN 'near_empty' WHEN invented > 0 THEN 'invented_words' WHEN unknown > 0 THEN 'wrong_language' END AS reason FROM t LEFT JOIN u USING (conv_id, turn)""",
)
def m_coherence(spark, sf_dir):
    """Assistant turns against the dictionaries of two languages."""
    found = checked_words(spark, sf_dir).select("conv_id", "turn", A.coherence(F.col("text"), F.col("unknown"), F.col("unknown_elsewhere")).alias("r"))
    return found.select("conv_id", "turn", "r.passed", F.try_element_at("r.details", F.lit("reason")).alias("reason"))


_EVAL = f"""{_ANSWERS}, {_M}, per AS (SELECT id, category, language, metric, role, CASE metric WHEN 'expected_stop_token' THEN ends_with(rtrim(answer), expected_token)
 WHEN 'contains_expected' THEN CASE WHEN len(list_concat(shared, expected_any)) > 0 THEN len(list_filter(list_concat(shared, expected_any), lambda e: contains(lower(answer), lower(e)))) > 0 END
 WHEN 'constraint_satisfied' THEN {_CONSTRAINT} WHEN 'not_empty' THEN regexp_matches(t, '[\\p{{L}}\\p{{N}}]') END AS ok FROM (SELECT *, {_BARE} AS t FROM a) JOIN m USING (category)),
 res AS (SELECT id, category, language, list(metric ORDER BY metric) FILTER (role = 'gate' AND NOT coalesce(ok, FALSE)) AS failed FROM per GROUP BY id, category, language)"""


@query("m_gate", f"WITH {_EVAL} SELECT id, category, language, coalesce(array_to_string(failed, ','), '') AS failed_checks, failed IS NULL AS passed FROM res")
def m_gate(spark, sf_dir):
    return evaluated(spark, sf_dir).select("id", "category", "language", F.array_join("failed_checks", ",").alias("failed_checks"), "passed")


@query("m_summary", f"WITH {_EVAL} SELECT category, language, count(*) AS total, count(*) FILTER (failed IS NULL) AS passed, round_even(count(*) FILTER (failed IS NULL) / count(*)::DOUBLE, 4) AS pass_rate FROM res GROUP BY GROUPING SETS ((), (category, language))")
def m_summary(spark, sf_dir):
    return E.summary(evaluated(spark, sf_dir))


@query("m_metric_counts", f"WITH {_EVAL} SELECT category, language, metric, count(*) AS ran, count(*) FILTER (ok) AS passed FROM per GROUP BY ALL")
def m_metric_counts(spark, sf_dir):
    return E.metric_counts(evaluated(spark, sf_dir))


@query("m_metric_pivot", f"WITH {_EVAL} SELECT category, CAST(sum(CASE WHEN metric = 'contains_expected' AND ok THEN 1 ELSE 0 END) AS BIGINT) AS contains_expected, CAST(sum(CASE WHEN metric = 'expected_stop_token' AND ok THEN 1 ELSE 0 END) AS BIGINT) AS expected_stop_token FROM per GROUP BY category")
def m_metric_pivot(spark, sf_dir):
    per = evaluated(spark, sf_dir).select("category", F.explode("metrics").alias("m")).select("category", "m.metric", "m.passed")
    names = ["contains_expected", "expected_stop_token"]
    return per.groupBy("category").pivot("metric", names).agg(F.count_if("passed")).na.fill(0, names)


_S = f"{_EVAL}, s AS (SELECT (CAST(substr(id, 2) AS BIGINT) % 3 + 1) * 100 AS step, category, round_even(count(*) FILTER (failed IS NULL) / count(*)::DOUBLE, 4) AS pass_rate FROM res GROUP BY ALL)"


@query("m_delta", f"WITH {_S} SELECT *, round(pass_rate - lag(pass_rate) OVER w, 6) AS delta, lag(pass_rate) OVER w IS NULL AS new FROM s WINDOW w AS (PARTITION BY category ORDER BY step)")
def m_delta(spark, sf_dir):
    return E.deltas(steps(spark, sf_dir))


_TH = "CASE category " + " ".join(f"WHEN '{c}' THEN {t}" for c, t in E.THRESHOLDS.items()) + " END"


@query("m_stability", f"WITH {_S}, o AS (SELECT *, pass_rate >= {_TH} AS ok, min(pass_rate) OVER (PARTITION BY step) >= 0.6 AS above_floor FROM s) SELECT *, ok AND coalesce(lag(ok) OVER (PARTITION BY category ORDER BY step), FALSE) AS stable FROM o")
def m_stability(spark, sf_dir):
    return E.stable(steps(spark, sf_dir))


@query("m_weakest", f"WITH {_S} SELECT step, min(pass_rate) AS score FROM s WHERE category IN ('turn_taking', 'uncertainty') GROUP BY step")
def m_weakest(spark, sf_dir):
    return E.weakest(steps(spark, sf_dir), ("turn_taking", "uncertainty"))


@query("m_turn_structure", f"WITH {_EVAL}, bad AS (SELECT id, category, bool_or(metric IN ('expected_stop_token', 'repetition') AND NOT coalesce(ok, FALSE)) AS b FROM per GROUP BY ALL) SELECT category, 1 - avg(CASE WHEN b THEN 1.0::DOUBLE ELSE 0 END) AS score FROM bad GROUP BY category")
def m_turn_structure(spark, sf_dir):
    return E.turn_structure(evaluated(spark, sf_dir))


INSTRUCTIONS = [
    ("i1", "Answer with a single number only. What is 15 plus 11?", "single_number", None),
    ("i2", "List three numbers between one and ten.", "exact_item_count", "3"),
    ("i3", "Repeat the word 'lamp'.", "exact_match", "lamp"),
    ("i4", "Explain it in one sentence.", "sentence_count", "1"),
    ("i5", "Use at most five words.", "max_words", "5"),
    ("i6", "Responda em letras minúsculas.", "lowercase", None),
    ("i7", "Tell me about rain.", None, None),
    ("i8", "Say \"stone\" backwards.", "reverse_word", "stone"),
    ("i9", "Dê um exemplo de fruta.", "exact_item_count", "1"),
]


_ASKED = f"q AS (SELECT conv_id, k FROM (SELECT conv_id, texts[1] AS ask, conv_id % {len(INSTRUCTIONS)} AS k FROM rws)), i(k, constraint_type, constraint_value) AS (VALUES {_values([(j, c, d) for j, (_, _, c, d) in enumerate(INSTRUCTIONS)])})"


def asked(spark, sf_dir):
    """conv_id, text: dialogues' first turns with an instruction before them."""
    told = F.get(F.array(*[F.lit(b) for _, b, _, _ in INSTRUCTIONS]), (F.col("conv_id") % len(INSTRUCTIONS)).cast("int"))
    return rows(spark, sf_dir).select("conv_id", F.concat(told, F.lit(" "), F.get("messages", F.lit(0))["content"]).alias("text"))


@query("infer_constraint", f"WITH {ROWS}, {_ASKED} SELECT conv_id, constraint_type, constraint_value FROM q JOIN i USING (k)")
def infer_constraint(spark, sf_dir):
    found = asked(spark, sf_dir).withColumn("c", A.infer_constraint(F.col("text")))
    return found.select("conv_id", "c.constraint_type", "c.constraint_value")


@query("constraint_review", f"WITH {ROWS}, {_ASKED} SELECT constraint_type IS NOT NULL AS tagged, count(*) AS n FROM q JOIN i USING (k) GROUP BY 1")
def constraint_review(spark, sf_dir):
    return infer_constraint(spark, sf_dir).groupBy(F.col("constraint_type").isNotNull().alias("tagged")).agg(F.count("*").alias("n"))


@query("constraint_tags", f"WITH {ROWS}, {_ASKED} SELECT CASE WHEN constraint_type IS NULL THEN 'review' ELSE 'tagged' END AS file, count(*) AS rows FROM q JOIN i USING (k) GROUP BY 1")
def constraint_tags(spark, sf_dir):
    """Dialogues written with their constraint, and those left for review, read back."""
    from ..sources import writers as W

    tagged, review = W.scratch(spark), W.scratch(spark)
    told = rows(spark, sf_dir).select("conv_id", "messages").join(asked(spark, sf_dir), "conv_id")
    W.tagged(told, F.col("text"), tagged, review)
    count = lambda name, path: spark.read.json(path).agg(F.lit(name).alias("file"), F.count("*").alias("rows"))
    return count("tagged", tagged).unionByName(count("review", review))


@query("json_arrays", "SELECT conv_id, role AS name, turn AS k FROM conversations")
def json_arrays(spark, sf_dir):
    """Objects of JSON arrays in answers, code fences taken off; what is no array gives nothing.

    Each dialogue's turns are written as such an answer, every other one in a fence, with a number and a text beside."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.col("role").alias("name"), F.col("turn").alias("k")))).alias("x"))
    body = F.concat(F.lit(" "), F.regexp_replace(F.to_json("x"), "\\]$", ", 7]"))
    fenced = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    texts = turns.select("conv_id", fenced.alias("text")).unionByName(turns.select("conv_id", F.lit("no array").alias("text")))
    return A.json_objects(texts, "text").select("conv_id", F.get_json_object("object", "$.name").alias("name"), F.get_json_object("object", "$.k").cast("long").alias("k"))


@query("m_top_questions", f"WITH {ROWS}, q AS (SELECT category, source, count(*) AS n FROM rws GROUP BY ALL) SELECT category, source, n FROM q ORDER BY n DESC, category, source LIMIT 15")
def m_top_questions(spark, sf_dir):
    """The fifteen largest groups of dialogues by category and file, in order."""
    return D.top(rows(spark, sf_dir).groupBy("category", "source").agg(F.count("*").alias("n")), "n", ["category", "source"], 15)
