"""Chat formatting with SQL functions alone: perspective rotation.

For every participant of a conversation the dialogue is rendered once, with
that speaker as the assistant, all others as named users, and the system's
turns as they are.  A turn is a row: its rendered segment, where the segment
starts in the rendered dialogue, and the range to learn from (the assistant's
text and end mark), all in code points.  So a conversation of any length is
never gathered in one task: segments ordered by turn make up the dialogue, and
offsets are sums in two steps, over chunks of turns.

Cases: a null text is an empty turn; a null turn comes last; a null conv_id is a
conversation of its own; equal turns are ordered by role and text, those without
a number by a hash of both before; repeated rows each stay; a conversation of system turns alone has no participant and no rows; marks within texts are made
harmless; an empty table gives no rows; further columns are ignored.

A participant is a role.  Its name is the role itself, letters, marks and digits
of all scripts, "_" and "-" as they are and every other character as %XX for each
of its bytes in UTF-8, so no two roles share a name; a null role is "%null" and an
empty one "%empty".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import tables as T

START, END = "<|im_start|>", "<|im_end|>"
SYSTEM = ("system",)
CHUNK = 256


_OTHER = "[^\\p{L}\\p{M}\\p{N}_-]"


def named(role: Column) -> Column:
    """A name that no other role has, and that holds no white space or mark."""
    bytes_of = lambda c: F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")
    letters = F.transform(F.filter(F.split(role, ""), lambda c: c != ""), lambda c: F.when(c.rlike(_OTHER), bytes_of(c)).otherwise(c))
    spelled = F.when(role.rlike(_OTHER), F.array_join(letters, "")).otherwise(role)
    return F.when(role.isNull(), F.lit("%null")).when(role == "", F.lit("%empty")).otherwise(spelled)


def rotations(conversations: DataFrame, system=SYSTEM) -> DataFrame:
    """conv_id, participant, turn, place, segment, start, mask_start, mask_end (-1 where there is nothing to learn)."""
    turns = conversations.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        named(F.col("role").cast("string")).alias("speaker"),
        F.regexp_replace(F.coalesce("text", F.lit("")), "<\\|", "< |").alias("text"),
    )
    turns = turns.withColumn("tie", F.xxhash64("speaker", "text"))
    # turns without a number, which come last, are cut by their order as well
    turns = turns.withColumn("chunk", F.coalesce(F.floor(F.col("turn") / CHUNK), F.lit(1 << 62) + F.shiftright(F.col("tie"), 56)))
    people = turns.filter(~F.col("speaker").isin(*system)).groupBy(F.col("conv_id").alias("c"), F.col("speaker").alias("participant")).agg(F.lit(1).alias("_")).drop("_")
    views = turns.join(people, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    own = F.col("speaker") == F.col("participant")
    head = (
        F.when(own, F.lit(f"{START}assistant\n"))
        .when(F.col("speaker").isin(*system), F.concat(F.lit(START), "speaker", F.lit("\n")))
        .otherwise(F.concat(F.lit(f"{START}user name="), "speaker", F.lit("\n")))
    )
    views = views.select(
        "conv_id", "participant", "turn", "chunk", "tie", "speaker", own.alias("own"), F.length(head).alias("head"), F.length("text").alias("body"), F.concat(head, "text", F.lit(f"{END}\n")).alias("segment")
    ).withColumn("n", F.length("segment").cast("long"))
    sums = views.groupBy("conv_id", "participant", "chunk").agg(F.sum("n").alias("chars"), F.count("*").alias("turns"))
    by_chunk = Window.partitionBy("conv_id", "participant").orderBy("chunk")
    before = sums.select(
        F.col("conv_id").alias("c"),
        F.col("participant").alias("p"),
        F.col("chunk").alias("k"),
        (F.sum("chars").over(by_chunk) - F.col("chars")).alias("chars_before"),
        (F.sum("turns").over(by_chunk) - F.col("turns")).alias("turns_before"),
    )
    local = Window.partitionBy("conv_id", "participant", "chunk").orderBy(F.col("turn").asc_nulls_last(), F.when(F.col("turn").isNull(), F.col("tie")), "speaker", "segment").rowsBetween(Window.unboundedPreceding, 0)
    views = views.withColumn("up_to", F.sum("n").over(local)).withColumn("place", F.row_number().over(local))
    views = views.join(before, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("participant") == F.col("p")) & (F.col("chunk") == F.col("k")))
    start = F.col("chars_before") + F.col("up_to") - F.col("n")
    return views.select(
        "conv_id",
        "participant",
        "turn",
        (F.col("turns_before") + F.col("place") - 1).alias("place"),
        "segment",
        start.alias("start"),
        F.when(F.col("own"), start + F.col("head")).otherwise(-1).alias("mask_start"),
        F.when(F.col("own"), start + F.col("head") + F.col("body") + len(END)).otherwise(-1).alias("mask_end"),
    )


def op10_chat_format(spark, sf_dir: str) -> DataFrame:
    return rotations(T.read(spark, sf_dir, "conversations"))


# A role's name by the rule: null and empty have names of their own, and characters that are no letter, mark or number of
# any script, "_" or "-" are spelled by their bytes.  Turns without a number, which a hash orders, do not occur here.
ORACLE = """
WITH r AS (SELECT role, CASE WHEN role IS NULL THEN '%null' WHEN role = '' THEN '%empty'
        ELSE array_to_string(list_transform(string_split(role, ''), lambda c: CASE WHEN regexp_matches(c, '[\\p{L}\\p{M}\\p{N}_-]') THEN c ELSE regexp_replace(hex(c), '(..)', '%\\1', 'g') END), '') END AS speaker
      FROM (SELECT DISTINCT role FROM conversations)),
t AS (SELECT conv_id, turn, speaker, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations c JOIN r ON c.role IS NOT DISTINCT FROM r.role),
p AS (SELECT DISTINCT conv_id AS c, speaker AS participant FROM t WHERE speaker <> 'system'),
v AS (SELECT t.*, participant, speaker = participant AS own,
        CASE WHEN speaker = participant THEN '<|im_start|>assistant' || chr(10) WHEN speaker = 'system' THEN '<|im_start|>system' || chr(10) ELSE '<|im_start|>user name=' || speaker || chr(10) END AS head
      FROM t JOIN p ON conv_id IS NOT DISTINCT FROM c),
s AS (SELECT *, head || text || '<|im_end|>' || chr(10) AS segment FROM v),
o AS (SELECT *, CAST(sum(length(segment)) OVER w AS BIGINT) - length(segment) AS start, row_number() OVER w - 1 AS place FROM s
      WINDOW w AS (PARTITION BY conv_id, participant ORDER BY turn NULLS LAST, speaker, segment ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT conv_id, participant, turn, place, segment, start,
       CASE WHEN own THEN start + length(head) ELSE -1 END AS mask_start,
       CASE WHEN own THEN start + length(head) + length(text) + 10 ELSE -1 END AS mask_end
FROM o
"""
