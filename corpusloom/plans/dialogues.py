"""Conversation queries.  The table has no category, language or source file: they are derived from conv_id as stand-ins."""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import generation as G
from ..operators import dialogues as D
from ..operators import ranges
from .base import literal, query, table

_CATS = sorted(D.MESSAGE_COUNTS)


def turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").withColumn("source", F.concat(F.lit("file"), (F.col("conv_id") % 7).cast("string")))


def rows(spark, sf_dir):
    names = F.array(*[F.lit(c) for c in _CATS])
    out = D.assemble(table(spark, sf_dir, "conversations"))
    return out.select(
        "conv_id",
        F.get(names, (F.col("conv_id") % len(_CATS)).cast("int")).alias("category"),
        F.when(F.col("conv_id") % 2 == 0, "en").otherwise("pt").alias("language"),
        F.concat(F.lit("file"), (F.col("conv_id") % 7).cast("string")).alias("source"),
        "messages",
    )


_NORM = "regexp_replace(regexp_replace(lower(trim({}, ' ' || chr(9) || chr(10) || chr(13))), '\\s+', ' ', 'g'), '[.!?]+$', '')"
ROWS = f"""c AS (SELECT conv_id, list(role ORDER BY turn, role, text) AS roles, list(text ORDER BY turn, role, text) AS texts FROM conversations GROUP BY conv_id),
rws AS (SELECT conv_id, [{', '.join(literal(c) for c in _CATS)}][conv_id % 6 + 1] AS category, CASE WHEN conv_id % 2 = 0 THEN 'en' ELSE 'pt' END AS language, 'file' || (conv_id % 7) AS source, roles, texts, len(roles) AS n FROM c)"""
_QA = f"qa AS (SELECT *, {_NORM.format('texts[-2]')} AS question, {_NORM.format('texts[-1]')} AS answer FROM rws WHERE n >= 2)"


@query("conv_assemble", f"WITH {ROWS} SELECT conv_id, CAST(n AS BIGINT) AS messages, array_to_string(roles, ',') AS roles, md5(array_to_string(texts, chr(1))) AS texts_md5 FROM rws")
def conv_assemble(spark, sf_dir):
    m = D.assemble(table(spark, sf_dir, "conversations"))
    texts = F.array_join(F.transform("messages", lambda x: x["content"]), "\x01")
    return m.select("conv_id", F.size("messages").cast("long").alias("messages"), F.array_join(F.transform("messages", lambda x: x["role"]), ",").alias("roles"), F.md5(F.encode(texts, "UTF-8")).alias("texts_md5"))


_EXPECTED = "CASE category || '/' || n " + " ".join(f"WHEN '{c}/{d}' THEN {100 * x}::DOUBLE" for c, xs in D.DEPTH_SHARES.items() for d, x in xs.items()) + " END"


@query("conv_turn_depth", f"WITH {ROWS}, d AS (SELECT category, n, count(*) AS k FROM rws GROUP BY ALL) SELECT category, n AS depth, k AS n, round_even(100 * k / (sum(k) OVER (PARTITION BY category))::DOUBLE, 1) AS pct, {_EXPECTED} AS expected_pct FROM d")
def conv_turn_depth(spark, sf_dir):
    return D.turn_depth(rows(spark, sf_dir))


_CASES = " ".join(f"WHEN category = {literal(c)} THEN n NOT BETWEEN {a} AND {b}" for c, (a, b) in D.MESSAGE_COUNTS.items())
_ORDER = f"""list_filter([CASE WHEN list_contains(roles, 'system') THEN 'system' END, CASE WHEN roles[1] <> 'user' THEN 'first' END, CASE WHEN roles[-1] <> 'assistant' THEN 'last' END,
 CASE WHEN len(list_filter(range(1, n), lambda i: roles[i] = roles[i + 1])) > 0 THEN 'alternation' END, CASE WHEN len(list_filter(texts, lambda t: regexp_matches(t, {literal(D.FORBIDDEN)}))) > 0 THEN 'forbidden' END,
 CASE WHEN CASE {_CASES} END THEN 'message_count' END], lambda x: x IS NOT NULL)"""


@query("conv_validate", f"WITH {ROWS} SELECT conv_id, array_to_string({_ORDER}, ',') AS errors FROM rws")
def conv_validate(spark, sf_dir):
    return rows(spark, sf_dir).select("conv_id", F.array_join(D.errors(F.col("category"), F.col("language"), F.col("messages")), ",").alias("errors"))


@query("conv_validation_by_file", f"WITH {ROWS} SELECT source, count(*) AS total, CAST(sum(CASE WHEN len({_ORDER}) > 0 THEN 1 ELSE 0 END) AS BIGINT) AS failed FROM rws GROUP BY source")
def conv_validation_by_file(spark, sf_dir):
    bad = F.size(D.errors(F.col("category"), F.col("language"), F.col("messages"))) > 0
    return rows(spark, sf_dir).groupBy("source").agg(F.count("*").alias("total"), F.count_if(bad).alias("failed"))


@query("conv_alternation", "SELECT conv_id, turn, role FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) WHERE role = before")
def conv_alternation(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").withColumn("before", F.lag("role").over(w)).filter("role = before").select("conv_id", "turn", "role")


@query(
    "conv_bare_ack",
    f"WITH t AS (SELECT *, 'file' || (conv_id % 7) AS source, max(turn) OVER (PARTITION BY conv_id) AS last, count(*) OVER (PARTITION BY conv_id) AS k FROM conversations) SELECT source, count(*) AS total, CAST(sum(CASE WHEN regexp_matches(trim(text), {literal(D.BARE_ACK)}) THEN 1 ELSE 0 END) AS BIGINT) AS bare FROM t WHERE role = 'assistant' AND k > 2 AND turn < last GROUP BY source",
)
def conv_bare_ack(spark, sf_dir):
    return D.bare_acknowledgements(turns(spark, sf_dir))


_LEN = "w AS (SELECT category, source, list_sum(list_transform(range(1, n + 1), lambda i: CASE WHEN roles[i] = 'assistant' THEN len(list_filter(regexp_split_to_array(texts[i], '\\s+'), lambda x: x <> '')) ELSE 0 END)) AS words FROM rws)"
_LEN_OF = "SELECT '{0}' AS by, {0} AS name, count(*) AS rows, round_even(avg(words), 1) AS mean, CAST(list(words ORDER BY words)[count(*) // 2 + 1] AS BIGINT) AS median, CAST(min(words) AS BIGINT) AS least, CAST(max(words) AS BIGINT) AS most FROM w GROUP BY {0}"


@query("conv_content_length", f"WITH {ROWS}, {_LEN} {_LEN_OF.format('category')} UNION ALL {_LEN_OF.format('source')}")
def conv_content_length(spark, sf_dir):
    return D.content_length(rows(spark, sf_dir))


@query(
    "conv_answer_concentration",
    f"WITH {ROWS}, {_QA}, p AS (SELECT category, language, question, answer, count(*) AS k FROM qa GROUP BY ALL), g AS (SELECT category, language, question, CAST(sum(k) AS BIGINT) AS n, count(*) AS distinct_answers, list(answer ORDER BY k DESC, answer)[1] AS top_answer, max(k) AS top_count FROM p GROUP BY ALL) SELECT *, n >= 5 AND (top_count / n::DOUBLE >= 0.5 OR distinct_answers <= 2) AS flagged FROM g",
)
def conv_answer_concentration(spark, sf_dir):
    return D.answer_concentration(rows(spark, sf_dir))


@query(
    "conv_exact_duplicates",
    f"WITH {ROWS}, g AS (SELECT roles, texts, count(*) AS n FROM rws GROUP BY ALL) SELECT CAST(sum(n) AS BIGINT) AS total_rows, count(*) FILTER (n > 1) AS duplicate_groups, CAST(sum(n - 1) AS BIGINT) AS extra_copies, round_even(100 * sum(n - 1) / sum(n)::DOUBLE, 2) AS pct FROM g",
)
def conv_exact_duplicates(spark, sf_dir):
    return D.exact_duplicates(rows(spark, sf_dir))


_TARGETS = ", ".join(f"({literal(c)}, '{x}', {t})" for c, t in D.TARGETS.items() for x in D.LANGUAGES)


@query("conv_balance", f"WITH {ROWS}, t(category, language, target) AS (VALUES {_TARGETS}), h AS (SELECT category, language, count(*) AS n FROM rws GROUP BY ALL) SELECT category, language, CAST(target AS BIGINT) AS target, coalesce(n, 0) AS n, round_even(100 * coalesce(n, 0) / target::DOUBLE, 1) AS pct FROM t LEFT JOIN h USING (category, language)")
def conv_balance(spark, sf_dir):
    return D.balance(rows(spark, sf_dir))


@query("conv_final_qa", f"WITH {ROWS}, {_QA} SELECT conv_id, question, answer FROM qa")
def conv_final_qa(spark, sf_dir):
    return rows(spark, sf_dir).select("conv_id", D.final_question(F.col("messages")).alias("question"), D.final_answer(F.col("messages")).alias("answer")).filter("question is not null")


@query("conv_samples", "SELECT conv_id, source FROM (SELECT conv_id, 'file' || (conv_id % 7) AS source, row_number() OVER (PARTITION BY conv_id % 7 ORDER BY md5('0:' || conv_id), conv_id) AS k FROM (SELECT DISTINCT conv_id FROM conversations)) WHERE k <= 5")
def conv_samples(spark, sf_dir):
    return D.stratified(rows(spark, sf_dir), "source", "conv_id", 5).select("conv_id", "source")


@query("conv_row_ids", f"WITH {ROWS} SELECT conv_id, category || '_' || language || '_' || lpad(CAST(row_number() OVER (PARTITION BY category, language ORDER BY conv_id) AS VARCHAR), 5, '0') AS id FROM rws")
def conv_row_ids(spark, sf_dir):
    r = rows(spark, sf_dir).select("conv_id", "category", "language")
    placed = ranges.numbered(ranges.ranged(r, "conv_id", F.xxhash64("conv_id")), ["conv_id"], ("category", "language"))
    return placed.select("conv_id", F.format_string("%s_%s_%05d", "category", "language", "place").alias("id"))


@query("exclusion_anti", f"WITH {ROWS}, x AS (SELECT DISTINCT roles, texts FROM rws WHERE language = 'pt'), m AS (SELECT min(conv_id) AS conv_id, roles, texts FROM rws WHERE language = 'en' GROUP BY roles, texts) SELECT conv_id FROM m ANTI JOIN x USING (roles, texts)")
def exclusion_anti(spark, sf_dir):
    r = rows(spark, sf_dir)
    return D.new_rows(r.filter("language = 'en'").select("conv_id", "messages"), r.filter("language = 'pt'")).select("conv_id")


# Generation quotas.
@query(
    "depth_targets",
    "WITH s(category, depth, share, first) AS (VALUES "
    + ", ".join(f"('{c}', {d}, {x}::DOUBLE, {str(i == 0).lower()})" for c, xs in D.DEPTH_SHARES.items() for i, (d, x) in enumerate(xs.items()))
    + "), t AS (SELECT *, [" + ", ".join(f"{{'c': '{c}', 't': {t}}}" for c, t in D.TARGETS.items()) + "] AS ts FROM s), q AS (SELECT category, depth, first, list_filter(ts, lambda x: x.c = category)[1].t AS target, CAST(round_even(list_filter(ts, lambda x: x.c = category)[1].t * share, 0) AS BIGINT) AS k FROM t) SELECT category, CAST(depth AS BIGINT) AS depth, CAST(k + CASE WHEN first THEN target - sum(k) OVER (PARTITION BY category) ELSE 0 END AS BIGINT) AS quota FROM q",
)
def depth_targets(spark, sf_dir):
    return _depth_targets(spark)


def _depth_targets(spark):
    """Exact quotas; what rounding leaves goes to the first depth."""
    listed = [(c, d, x, i == 0, D.TARGETS[c]) for c, xs in D.DEPTH_SHARES.items() for i, (d, x) in enumerate(xs.items())]
    s = spark.createDataFrame(listed, "category string, depth long, share double, first boolean, target long")
    s = s.withColumn("k", F.bround(F.col("target") * F.col("share")).cast("long"))
    drift = F.col("target") - F.sum("k").over(Window.partitionBy("category"))
    return s.select("category", "depth", (F.col("k") + F.when(F.col("first"), drift).otherwise(0)).alias("quota"))


_QUOTA = ", ".join(
    f"('{c}', {d}, {q})"
    for c, xs in D.DEPTH_SHARES.items()
    for d, q in (lambda ks: [(d, k + (D.TARGETS[c] - sum(ks.values()) if i == 0 else 0)) for i, (d, k) in enumerate(ks.items())])({d: round(D.TARGETS[c] * x) for d, x in xs.items()})
)


@query("remaining_by_depth", f"WITH {ROWS}, q(category, depth, quota) AS (VALUES {_QUOTA}), h AS (SELECT category, n AS depth, count(*) AS have FROM rws GROUP BY ALL) SELECT category, CAST(depth AS BIGINT) AS depth, CAST(quota AS BIGINT) AS quota, coalesce(have, 0) AS have, CAST(greatest(0, quota - coalesce(have, 0)) AS BIGINT) AS remaining FROM q LEFT JOIN h USING (category, depth)")
def remaining_by_depth(spark, sf_dir):
    have = rows(spark, sf_dir).groupBy("category", F.size("messages").cast("long").alias("depth")).agg(F.count("*").alias("have"))
    left = _depth_targets(spark).join(have, ["category", "depth"], "left").withColumn("have", F.coalesce("have", F.lit(0)).cast("long"))
    return left.withColumn("remaining", F.greatest(F.lit(0).cast("long"), F.col("quota") - F.col("have")))


@query("quota_fill", f"WITH {ROWS} SELECT conv_id FROM (SELECT conv_id, row_number() OVER (PARTITION BY category, language, n ORDER BY conv_id) AS k FROM rws) WHERE k <= 3")
def quota_fill(spark, sf_dir):
    """The rows accepted until each category, language and depth has its quota, here of three."""
    order = Window.partitionBy("category", "language", F.size("messages")).orderBy("conv_id")
    return rows(spark, sf_dir).withColumn("k", F.row_number().over(order)).filter("k <= 3").select("conv_id")


@query("max_calls", f"WITH {ROWS}, t AS (SELECT category, count(*) AS n FROM rws GROUP BY category) SELECT category, n, CAST(least(250, greatest(3, ceil(ceil(n / (20 * 0.7)) * 1.5))) AS BIGINT) AS calls FROM t")
def max_calls(spark, sf_dir):
    n = rows(spark, sf_dir).groupBy("category").agg(F.count("*").alias("n"))
    return n.withColumn("calls", F.least(F.lit(250), F.greatest(F.lit(3), F.ceil(F.ceil(F.col("n") / (20 * 0.7)) * 1.5))).cast("long"))


# Benchmark leaks.
_BQ = _NORM.format("text")


@query("leak_exact", f"WITH b AS (SELECT item_id, {_BQ} AS q FROM benchmark), d AS (SELECT doc_id, {_BQ} AS q FROM documents) SELECT item_id, min(doc_id) AS doc_id, count(*) AS n FROM b JOIN d USING (q) GROUP BY item_id")
def leak_exact(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select("item_id", D.normalize(F.col("text")).alias("q"))
    d = table(spark, sf_dir, "documents").select("doc_id", D.normalize(F.col("text")).alias("q"))
    return d.groupBy("q").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).join(b, "q").select("item_id", "doc_id", "n")


def _gram(hashes, k, at):
    return F.xxhash64(*[F.get(hashes, at + i) for i in range(k)])


@query("leak_contains", "SELECT item_id, count(*) AS n, min(doc_id) AS first_doc FROM documents d JOIN benchmark b ON contains(lower(d.text), lower(b.text)) GROUP BY item_id")
def leak_contains(spark, sf_dir):
    """Documents that hold a whole item.  A document and an item meet by words of the item, then the text decides.

    An item of seven words or more is met by five words after its first, a shorter one by all words between its first and
    last, one of two words or one by the words of documents that end with its first word or hold it, and a blank one by
    every document."""
    words = lambda t: F.regexp_extract_all(F.lower(t), F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))
    # words as hashes: a gram is the hash of its words' hashes
    hashes = lambda w: F.transform(w, lambda x: F.xxhash64(x))
    items = table(spark, sf_dir, "benchmark").select("item_id", F.lower("text").alias("item"), words(F.col("text")).alias("w")).filter("item is not null").withColumn("n", F.least(F.lit(7), F.size("w"))).withColumn("h", hashes(F.col("w")))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("doc"), words(F.col("text")).alias("w"))
    hashed = docs.select("doc_id", hashes(F.col("w")).alias("h"))
    sizes = {r["n"] for r in items.select("n").distinct().collect()}  # eight at most
    found = []
    for n in sorted(sizes - {0, 1, 2}) or [7]:
        k = n - 2
        every = F.when(F.size("h") >= k, F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("h") - k)), partial(_gram, F.col("h"), k)))
        keys = hashed.select("doc_id", F.explode(F.array_distinct(every)).alias("key"))
        long = items.filter(F.col("n") == n).select("item_id", "item", _gram(F.col("h"), k, F.lit(1)).alias("key"))  # the first word may begin inside another
        found.append(keys.join(long, "key").select("doc_id", "item_id", "item"))
    if sizes & {1, 2}:
        held = docs.select("doc_id", F.explode(F.array_distinct("w")).alias("word"))
        short = items.filter("n in (1, 2)").select("item_id", "item", "n", F.get("w", F.lit(0)).alias("one"))
        near = F.when(F.col("n") == 1, F.contains("word", "one")).otherwise(F.endswith("word", "one"))
        met = held.select("word").distinct().join(F.broadcast(short), near).select("word", "item_id", "item")
        found.append(held.join(met, "word").select("doc_id", "item_id", "item"))
    if 0 in sizes:
        found.append(docs.select("doc_id").crossJoin(items.filter("n = 0").select("item_id", "item")))
    hits = reduce(lambda a, b: a.unionByName(b), found).distinct()
    return hits.join(docs.select("doc_id", "doc"), "doc_id").filter(F.contains("doc", "item")).groupBy("item_id").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


@query("leak_answers", f"WITH {ROWS}, {_QA}, b AS (SELECT category, language, question, min(conv_id) AS first, arg_min(answer, conv_id) AS expected FROM qa GROUP BY ALL HAVING count(*) > 1) SELECT category, language, question, count(*) AS n, CAST(sum(CASE WHEN contains(answer, expected) THEN 1 ELSE 0 END) AS BIGINT) AS leaked FROM qa JOIN b USING (category, language, question) WHERE conv_id <> first GROUP BY ALL")
def leak_answers(spark, sf_dir):
    """The first dialogue of each question stands as the benchmark's; how many others ask it, and how many of them give its answer.

    Equal answers are one row with a count before they meet the expected one."""
    qa = rows(spark, sf_dir).select("conv_id", "category", "language", D.final_question(F.col("messages")).alias("question"), D.final_answer(F.col("messages")).alias("answer")).filter("question is not null")
    keys = ["category", "language", "question"]
    first = qa.groupBy(*keys).agg(F.min(F.struct("conv_id", "answer")).alias("first"), F.count("*").alias("all")).filter("all > 1").select(*keys, F.col("first.answer").alias("expected"))
    per = qa.groupBy(*keys, "answer").agg(F.count("*").alias("k")).join(first, keys)
    others = F.col("k") - F.when(F.col("answer") == F.col("expected"), 1).otherwise(0)
    return per.groupBy(*keys).agg(F.sum(others).alias("n"), F.sum(F.when(F.contains("answer", "expected"), others).otherwise(0)).alias("leaked"))


# Files and partial outputs.
def _filed(spark, sf_dir):
    """Dialogues as rows of files, some with the id of the row before, some malformed."""
    r = rows(spark, sf_dir)
    return r.withColumn("id", F.concat(F.lit("r"), F.when(F.col("conv_id") % 10 == 9, F.col("conv_id") - 7).otherwise(F.col("conv_id")))).withColumn("malformed", F.when(F.col("conv_id") % 13 == 5, F.lit("{")))


_FILED = f"x AS (SELECT *, 'r' || CASE WHEN conv_id % 10 = 9 THEN conv_id - 7 ELSE conv_id END AS id, conv_id % 13 = 5 AS broken, len({_ORDER}) > 0 AS bad FROM rws)"


@query(
    "conv_file_report",
    f"WITH {ROWS}, {_FILED}, y AS (SELECT *, NOT broken AND conv_id <> min(conv_id) FILTER (NOT broken) OVER (PARTITION BY source, id) AS again FROM x) SELECT source, count(*) AS total, count(*) FILTER (broken) AS malformed, count(*) FILTER (again) AS duplicate_ids, count(*) FILTER (broken OR again OR bad) AS failed FROM y GROUP BY source",
)
def conv_file_report(spark, sf_dir):
    return D.file_report(_filed(spark, sf_dir), ["conv_id"])


@query(
    "conv_resume_problems",
    f"WITH {ROWS}, {_FILED}, y AS (SELECT *, count(*) OVER (PARTITION BY id) AS ids, count(*) OVER (PARTITION BY roles, texts) AS same FROM x) SELECT conv_id, CASE WHEN category <> 'correction' THEN 'category' WHEN language <> 'en' THEN 'language' WHEN conv_id % 17 = 3 THEN 'stage' WHEN bad THEN 'invalid' WHEN ids > 1 THEN 'duplicate_id' WHEN same > 1 THEN 'duplicate_content' END AS problem FROM y WHERE problem IS NOT NULL",
)
def conv_resume_problems(spark, sf_dir):
    """The dialogues that may not be in a partial output of one category and language, and why."""
    r = _filed(spark, sf_dir).withColumn("stage", F.when(F.col("conv_id") % 17 == 3, "stage1").otherwise("stage0"))
    return D.resume_problems(r, "correction", "en", "conv_id")


@query("dedup_top_files", f"WITH {ROWS}, g AS (SELECT roles, texts, count(*) AS n FROM rws GROUP BY ALL) SELECT source, count(*) AS rows, count(*) FILTER (g.n > 1) AS in_groups FROM rws JOIN g USING (roles, texts) GROUP BY source ORDER BY in_groups DESC, source LIMIT 3")
def dedup_top_files(spark, sf_dir):
    """The files with the most dialogues that are elsewhere too, in order."""
    r = rows(spark, sf_dir).select("source", D.content_key(F.col("messages")).alias("k"))
    per = r.groupBy("k", "source").agg(F.count("*").alias("c"))
    groups = per.groupBy("k").agg(F.sum("c").alias("n"))
    found = per.join(groups, "k").groupBy("source").agg(F.sum("c").alias("rows"), F.sum(F.when(F.col("n") > 1, F.col("c")).otherwise(0)).alias("in_groups"))
    return D.top(found, "in_groups", ["source"], 3)


# Generation requests.
@query(
    "prompt_build",
    f"WITH {ROWS}, q(category, depth, quota) AS (VALUES {_QUOTA}), h AS (SELECT category, n AS depth, count(*) AS have FROM rws GROUP BY ALL), r AS (SELECT category, depth, greatest(0, quota - coalesce(have, 0)) AS n FROM q LEFT JOIN h USING (category, depth)) SELECT category, language, depth::BIGINT AS depth, 'Category: ' || category || '. Messages: ' || depth || '. Language: ' || CASE language WHEN 'en' THEN 'English' ELSE 'Brazilian Portuguese' END || '. Exactly ' || n || ' examples, each unlike the others' || CASE WHEN category IN ('local_context', 'correction') THEN CASE depth WHEN 4 THEN '; nothing unrelated between' WHEN 6 THEN '; one unrelated exchange between' ELSE '; two unrelated exchanges between' END ELSE '' END || '.' AS prompt FROM r, (VALUES ('en'), ('pt')) v(language) WHERE n > 0",
)
def prompt_build(spark, sf_dir):
    """A request for each category, depth and language whose quota is open."""
    open_ = remaining_by_depth(spark, sf_dir).filter("remaining > 0").withColumn("language", F.explode(F.array(*[F.lit(x) for x in D.LANGUAGES])))
    return open_.select("category", "language", "depth", G.prompt(F.col("category"), F.col("language"), F.col("remaining"), F.col("depth")).alias("prompt"))


_WEIGHTS = {"src0": 5.0, "src1": 0.0, "src2": 2.0, "src3": 1.0}


@query("weighted_choice", "WITH u AS (SELECT conv_id, ('0x' || substr(md5('5:' || conv_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE * 8 AS u FROM (SELECT DISTINCT conv_id FROM conversations)) SELECT conv_id, CASE WHEN u < 5 THEN 'src0' WHEN u < 7 THEN 'src2' ELSE 'src3' END AS choice FROM u")
def weighted_choice(spark, sf_dir):
    """A name for each dialogue, drawn by weights from a seeded hash."""
    ids = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    return ids.select("conv_id", G.weighted(F.md5(F.concat(F.lit("5:"), F.col("conv_id").cast("string"))), _WEIGHTS).alias("choice"))


TOOLS = [("fs_read", ["path"]), ("fs_write", ["path", "content"]), ("status", [])]


@query("tool_block", f"WITH t(i, name, args) AS (VALUES {', '.join(f'({i}, {literal(n)}, {literal(chr(44).join(a))})' for i, (n, a) in enumerate(TOOLS))}), k AS (SELECT DISTINCT conv_id FROM conversations WHERE role = 'system') SELECT conv_id, 'AVAILABLE TOOLS:' || chr(10) || string_agg('- ' || name || CASE WHEN args = '' THEN '' ELSE '(' || replace(args, ',', ', ') || ')' END, chr(10) ORDER BY i) AS block FROM k, t GROUP BY conv_id")
def tool_block(spark, sf_dir):
    """A list of tools for each dialogue that has a system turn."""
    tools = F.array(*[F.struct(F.lit(n).alias("name"), F.array(*[F.lit(x) for x in a]).cast("array<string>").alias("args")) for n, a in TOOLS])
    return table(spark, sf_dir, "conversations").filter("role = 'system'").select("conv_id").distinct().select("conv_id", G.tools_block(tools).alias("block"))


@query("json_pretty")
def json_pretty(spark, sf_dir):
    """Dialogues as JSON with sorted keys and an indent of two."""
    return rows(spark, sf_dir).select("conv_id", G.pretty(F.to_json(F.struct("category", "messages", "language"))).alias("json"))


@query("schema_check", f"WITH {ROWS} SELECT conv_id, CASE WHEN conv_id % 4 = 1 THEN 'next_agent' WHEN conv_id % 4 = 2 THEN 'why' WHEN conv_id % 4 = 3 THEN 'extra' END AS at FROM rws")
def schema_check(spark, sf_dir):
    """Routes made of the dialogues, three of four with a fault, against their schema: where it is broken."""
    k = F.col("conv_id") % 4
    route = F.struct(F.lit("route").alias("type"), F.when(k == 1, F.lit("nobody")).otherwise("planner").alias("next_agent"), F.create_map(F.lit("c"), "category").alias("blackboard_updates"), F.when(k == 2, F.repeat(F.lit("x"), 201)).otherwise("ok").alias("why"), F.when(k == 3, F.lit(1)).alias("extra"))
    found = rows(spark, sf_dir).select("conv_id", G.schema_problem(F.to_json(route), G.SCHEMAS["route"]).alias("p"))
    return found.select("conv_id", F.nullif(F.split("p", ":")[0], F.lit("")).alias("at"))
