"""Conversations: assembly, validation, and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.answers import normalize

# Categories with their message counts, targets and depth shares; languages, roles, forbidden tokens, bare acknowledgements.
MESSAGE_COUNTS = {
    "turn_taking": (2, 2),
    "knowledge_completion": (2, 2),
    "local_context": (4, 8),
    "correction": (4, 8),
    "instruction_following": (2, 6),
    "uncertainty": (2, 4),
}
TARGETS = {"turn_taking": 1500, "knowledge_completion": 1500, "local_context": 1500, "correction": 1500, "instruction_following": 1000, "uncertainty": 500}
DEPTH_SHARES = {
    "local_context": {4: 0.70, 6: 0.20, 8: 0.10},
    "correction": {4: 0.70, 6: 0.20, 8: 0.10},
    "instruction_following": {2: 0.90, 4: 0.10},
    "uncertainty": {2: 0.80, 4: 0.20},
}
LANGUAGES = ("en", "pt")
FORBIDDEN = "<(EOS|BOS|PAD|SEQ|MASK|SPECIAL-(1?[0-9]{1,2}))>"
BARE_ACK = "(?i)^(got it|understood|okay|ok|entendi|certo|combinado|ta bom|tá bom)\\.?$"
# End of fixed values.


def assemble(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """One row for each conversation: key, messages (role, content) in order of turn."""
    listed = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return turns.groupBy(key).agg(F.transform(listed, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def content_key(messages: Column) -> Column:
    return F.sha2(F.to_json(messages), 256)


def final_question(messages: Column) -> Column:
    return F.when(F.size(messages) >= 2, normalize(F.try_element_at(messages, F.lit(-2))["content"]))


def final_answer(messages: Column) -> Column:
    return normalize(F.try_element_at(messages, F.lit(-1))["content"])


def errors(category: Column, language: Column, messages: Column, stage: Column | None = None, row_id: Column | None = None, system_known: bool = True) -> Column:
    """The names of the rules a row breaks, in order.  After a break of shape the rules of order are not asked."""
    n, roles = F.size(messages), F.transform(messages, lambda m: m["role"])
    known = ["user", "assistant"] + ["system"] * system_known
    one = lambda cond, name: F.when(cond, F.lit(name))
    fields = [one(~F.coalesce(category.isin(*MESSAGE_COUNTS), F.lit(False)), "category"), one(~F.coalesce(language.isin(*LANGUAGES), F.lit(False)), "language")]
    if stage is not None:
        fields.append(one(~stage.eqNullSafe("stage0"), "stage"))
    if row_id is not None:
        fields.append(one(F.coalesce(F.trim(row_id), F.lit("")) == "", "id"))
    shape = fields + [
        one(messages.isNull() | (n <= 0), "messages"),
        one(F.exists(messages, lambda m: ~F.coalesce(m["role"].isin(*known), F.lit(False))), "role"),
        one(F.exists(messages, lambda m: F.coalesce(F.trim(m["content"]), F.lit("")) == ""), "content"),
    ]
    bad_count = F.lit(False)
    for name, (low, high) in MESSAGE_COUNTS.items():
        bad_count = bad_count | ((category == name) & ~n.between(low, high))
    pairs = F.zip_with(F.slice(roles, F.lit(1), F.greatest(F.lit(0), n - 1)), F.slice(roles, F.lit(2), F.greatest(F.lit(0), n - 1)), lambda a, b: a == b)
    order = [
        one(F.array_contains(roles, "system"), "system"),
        one(F.get(roles, F.lit(0)) != "user", "first"),
        one(F.try_element_at(roles, F.lit(-1)) != "assistant", "last"),
        one(F.exists(pairs, lambda x: x), "alternation"),
        one(F.exists(messages, lambda m: m["content"].rlike(FORBIDDEN)), "forbidden"),
        one(bad_count, "message_count"),
    ]
    found = lambda xs: F.filter(F.array(*xs), lambda x: x.isNotNull())
    return F.when(F.size(found(shape)) > 0, found(shape)).otherwise(found(order))


def exact_duplicates(rows: DataFrame) -> DataFrame:
    """total_rows, duplicate_groups, extra_copies, pct: of rows with equal messages."""
    groups = rows.groupBy(content_key(F.col("messages")).alias("k")).agg(F.count("*").alias("n"))
    extra = F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n") - 1)), F.lit(0)).cast("long")
    out = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total_rows"), F.count_if(F.col("n") > 1).alias("duplicate_groups"), extra.alias("extra_copies"))
    return out.withColumn("pct", F.when(F.col("total_rows") > 0, F.bround(100 * F.col("extra_copies") / F.col("total_rows"), 2)).otherwise(F.lit(0.0)))


def answer_concentration(rows: DataFrame, least: int = 5) -> DataFrame:
    """Questions asked often that few answers dominate. rows: category, language, messages. Ties go to the lower answer."""
    qa = rows.select("category", "language", final_question(F.col("messages")).alias("question"), final_answer(F.col("messages")).alias("answer")).filter("question is not null")
    per = qa.groupBy("category", "language", "question", "answer").agg(F.count("*").alias("k"))
    top = F.min(F.struct((-F.col("k")).alias("k"), "answer"))
    out = per.groupBy("category", "language", "question").agg(F.sum("k").alias("n"), F.count("*").alias("distinct_answers"), top.alias("top"))
    share = -F.col("top.k") / F.col("n")
    return out.select(
        "category", "language", "question", "n", "distinct_answers", F.col("top.answer").alias("top_answer"), (-F.col("top.k")).alias("top_count"), ((F.col("n") >= least) & ((share >= 0.5) | (F.col("distinct_answers") <= 2))).alias("flagged")
    )


def turn_depth(rows: DataFrame) -> DataFrame:
    """Rows by category and number of messages, with the share expected, null where none is."""
    per = rows.groupBy("category", F.size("messages").cast("long").alias("depth")).agg(F.count("*").alias("n"))
    wanted = F.create_map(*[F.lit(x) for c, shares in DEPTH_SHARES.items() for d, share in shares.items() for x in (f"{c}/{d}", 100 * share)])
    expected = F.try_element_at(wanted, F.concat_ws("/", "category", F.col("depth").cast("string")))
    return per.withColumn("pct", F.bround(100 * F.col("n") / F.sum("n").over(Window.partitionBy("category")), 1)).withColumn("expected_pct", expected)  # a row for each category and depth


def balance(rows: DataFrame) -> DataFrame:
    """Counts against targets for every category and language, empty cells too."""
    spark = rows.sparkSession
    cells = spark.createDataFrame([(c, x, t) for c, t in TARGETS.items() for x in LANGUAGES], "category string, language string, target long")
    have = rows.groupBy("category", "language").agg(F.count("*").alias("n"))
    return cells.join(have, ["category", "language"], "left").select("category", "language", "target", F.coalesce("n", F.lit(0)).cast("long").alias("n")).withColumn("pct", F.bround(100 * F.col("n") / F.col("target"), 1))


def bare_acknowledgements(turns: DataFrame, key: str = "conv_id", by: str = "source") -> DataFrame:
    """Assistant turns that are neither last nor alone, and how many merely acknowledge. turns: key, turn, role, text, by."""
    last = turns.groupBy(F.col(key).alias("k")).agg(F.max("turn").alias("last"), F.count("*").alias("messages"))
    mid = turns.join(last, turns[key] == F.col("k")).filter("role = 'assistant' and messages > 2 and turn < last")
    return mid.groupBy(by).agg(F.count("*").alias("total"), F.count_if(F.trim("text").rlike(BARE_ACK)).alias("bare"))


def content_length(rows: DataFrame) -> DataFrame:
    """Assistant words of a row: mean, upper median, least and most, by category and by source."""
    words = F.aggregate(
        F.filter("messages", lambda m: m["role"] == "assistant"), F.lit(0).cast("long"), lambda a, m: a + F.size(F.filter(F.split(m["content"], "\\s+"), lambda w: w != ""))
    )
    per = rows.select("category", "source", words.alias("words"))
    out = None
    for by in ("category", "source"):
        ranked = per.groupBy(F.lit(by).alias("by"), F.col(by).alias("name"), "words").agg(F.count("*").alias("k"))
        part = Window.partitionBy("by", "name")
        up_to = F.sum("k").over(part.orderBy("words"))
        ranked = ranked.withColumn("up_to", up_to).withColumn("all", F.sum("k").over(part))
        mid = F.min(F.when(F.col("up_to") > F.floor(F.col("all") / 2), F.col("words")))
        one = ranked.groupBy("by", "name").agg(F.sum("k").alias("rows"), F.bround(F.sum(F.col("words") * F.col("k")) / F.sum("k"), 1).alias("mean"), mid.alias("median"), F.min("words").alias("least"), F.max("words").alias("most"))
        out = one if out is None else out.unionByName(one)
    return out


def new_rows(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows whose messages are not there yet, each once: the first by key."""
    mine = rows.withColumn("k", content_key(F.col("messages")))
    once = mine.groupBy("k").agg(F.min(F.struct("conv_id", "messages")).alias("x"))
    return once.join(existing.select(content_key(F.col("messages")).alias("k")).distinct(), "k", "left_anti").select("x.*")


def stratified(rows: DataFrame, by: str, key: str, n: int, seed: int = 0) -> DataFrame:
    order = Window.partitionBy(by).orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key)
    return rows.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= n).drop("_k")


def file_report(rows: DataFrame, key: list[str]) -> DataFrame:
    """source, total, malformed, duplicate_ids, failed of files. rows: source, malformed, id, category, language, messages and ``key``, an order of rows.

    A row that is malformed is not asked for more, nor is one whose id an earlier row of the file has; blank ids are no duplicates."""
    bad = F.size(errors(F.col("category"), F.col("language"), F.col("messages"))) > 0
    first = rows.filter("malformed is null and coalesce(id, '') <> ''").groupBy("source", "id").agg(F.min(F.struct(*key)).alias("_first"))
    marked = rows.join(first, ["source", "id"], "left").withColumn("_again", F.coalesce(F.struct(*key) != F.col("_first"), F.lit(False)) & F.col("malformed").isNull())
    broken = F.col("malformed").isNotNull()
    wrong = ~broken & ~F.col("_again") & F.coalesce(bad, F.lit(True))
    return marked.groupBy("source").agg(
        F.count("*").alias("total"), F.count_if(broken).alias("malformed"), F.count_if("_again").alias("duplicate_ids"), F.count_if(broken | F.col("_again") | wrong).alias("failed")
    )


def resume_problems(rows: DataFrame, category: str, language: str, key: str = "id") -> DataFrame:
    """key, problem of rows that a partial output must not have: the first rule that a row breaks.

    rows: id, category, language, stage, messages.  Of equal ids, and of equal dialogues, each is named."""
    content = content_key(F.col("messages"))
    marked = rows.withColumn("_content", content)
    ids = marked.groupBy("id").agg(F.count("*").alias("_ids"))
    same = marked.groupBy("_content").agg(F.count("*").alias("_same"))
    marked = marked.join(ids, "id", "left").join(same, "_content", "left")
    problem = (
        F.when(~F.col("category").eqNullSafe(F.lit(category)), "category")
        .when(~F.col("language").eqNullSafe(F.lit(language)), "language")
        .when(~F.col("stage").eqNullSafe(F.lit("stage0")), "stage")
        .when(F.col("messages").isNull(), "messages")
        .when(F.size(errors(F.col("category"), F.col("language"), F.col("messages"))) > 0, "invalid")
        .when(F.coalesce("id", F.lit("")) == "", "id")
        .when(F.col("_ids") > 1, "duplicate_id")
        .when(F.col("_same") > 1, "duplicate_content")
    )
    return marked.select(key, problem.alias("problem")).filter("problem is not null")


def resumable(rows: DataFrame, category: str, language: str) -> DataFrame:
    """The rows, or an error that names one that must not be there."""
    found = resume_problems(rows, category, language).head(1)
    if found:
        raise ValueError(f"not safe to resume: {found[0].asDict()}")
    return rows


def checked(rows: DataFrame) -> DataFrame:
    """Rows of a training set, of which any that is malformed or invalid raises, and so does an empty set. rows: malformed, category, language, messages."""
    bad = F.col("malformed").isNotNull() | (F.size(errors(F.col("category"), F.col("language"), F.col("messages"))) > 0)
    n = rows.agg(F.count("*").alias("n"), F.count_if(F.coalesce(bad, F.lit(True))).alias("bad")).first()
    if not n["n"]:
        raise FileNotFoundError("no rows")
    if n["bad"]:
        raise RuntimeError(f"{n['bad']} of {n['n']} rows are not valid")
    return rows.drop("malformed")


def top(rows: DataFrame, by: str, ties: list[str], n: int) -> DataFrame:
    """The n rows of the highest value, ties by further columns, in that order."""
    return rows.orderBy(F.col(by).desc(), *ties).limit(n)
