"""Tokenizer and packing queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import quality
from ..functions import tokens as K
from ..operators import dialogues as D
from ..operators import packing as P
from ..operators import ranges
from ..sources import readers as R
from ..sources import writers as W
from .base import literal, query, table

# DuckDB has no look-ahead, so its oracles cut words at white space instead of the ordered branches.
_WORDS = "regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')"
SHARD, FRAME = 4096, 128


@query("pretok_counts")
def pretok_counts(spark, sf_dir):
    return K.token_counts(table(spark, sf_dir, "documents"))


@query("pretok_restores", "SELECT doc_id, TRUE AS restored FROM documents")
def pretok_restores(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", (F.array_join(K.pre_tokens(F.col("text")), "") == F.col("text")).alias("restored"))


@query("byte_round_trip", "SELECT doc_id, md5(text) AS text_md5, CAST(strlen(text) AS BIGINT) AS letters FROM documents")
def byte_round_trip(spark, sf_dir):
    coded = K.byte_encode(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.encode(K.byte_decode(coded), "UTF-8")).alias("text_md5"), F.length(coded).cast("long").alias("letters"))


@query("word_counts", f"SELECT word, count(*) AS freq FROM (SELECT unnest({_WORDS}) AS word FROM documents) GROUP BY word HAVING count(*) >= 5")
def word_counts(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("freq")).filter("freq >= 5")


@query(
    "pair_counts",
    f"""WITH w AS (SELECT word, count(*) AS freq FROM (SELECT unnest({_WORDS}) AS word FROM documents) GROUP BY word),
 p AS (SELECT unnest(list_transform(range(1, length(word)), lambda i: word[i] || chr(1) || word[i + 1])) AS x, freq FROM w WHERE length(word) > 1)
 SELECT string_split(x, chr(1))[1] AS left, string_split(x, chr(1))[2] AS right, CAST(sum(freq) AS BIGINT) AS freq FROM p GROUP BY x""",
)
def pair_counts(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))).alias("word"))
    return K.pair_counts(words.groupBy("word").agg(F.count("*").alias("freq")).select(K.splits(F.col("word")).alias("symbols"), "freq"))


#: Merges that make a vocabulary of a thousand with the byte letters.
MERGES = 1000 - len(K.byte_letters())


def _merges(spark, sf_dir):
    return K.train_merges(K.token_counts(table(spark, sf_dir, "documents")), MERGES)


@query("bpe_merges")
def bpe_merges(spark, sf_dir):
    """The merges of a byte-pair vocabulary of a thousand, over all documents' distinct pre-tokens."""
    return spark.createDataFrame([(i, *m) for i, m in enumerate(_merges(spark, sf_dir))], "step int, left string, right string, freq long")


def _vocab(spark, sf_dir):
    return K.vocabulary(_merges(spark, sf_dir))


@query("encode_counts")
def encode_counts(spark, sf_dir):
    """Tokens of each document by the trained vocabulary."""
    docs = table(spark, sf_dir, "documents")
    return K.encoded(docs, _vocab(spark, sf_dir)).select("doc_id", F.size("ids").cast("long").alias("tokens"))


@query("documents_tokenised")
def documents_tokenised(spark, sf_dir):
    """Documents that are not blank with their tokens' metrics, by the trained vocabulary."""
    docs, vocab = table(spark, sf_dir, "documents"), _vocab(spark, sf_dir)
    found = quality.tokenised(docs, lambda rows: K.encoded(rows, vocab, keep=tuple(rows.columns)))
    return found.select("doc_id", "id", "lang", F.col("token_count").cast("long").alias("token_count"), F.round("avg_chars_per_token", 6).alias("avg_chars_per_token"))


@query("encode_round_trip", "SELECT doc_id, md5(text) AS text_md5 FROM documents WHERE text <> ''")
def encode_round_trip(spark, sf_dir):
    vocab = _vocab(spark, sf_dir)
    names = F.array(*[F.lit(v) for v in vocab])
    coded = K.encoded(table(spark, sf_dir, "documents"), vocab).withColumn("ids", K.in_range(F.col("ids"), len(vocab)))
    text = K.byte_decode(F.array_join(F.transform("ids", lambda i: F.get(names, i)), ""))
    return coded.select("doc_id", F.md5(F.encode(text, "UTF-8")).alias("text_md5"))


def top_words(spark, sf_dir, n):
    """token_id, token: the most frequent words of the documents, ties by the word."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))).alias("token"))
    top = words.groupBy("token").agg(F.count("*").alias("freq")).orderBy(F.desc("freq"), "token").limit(n)
    return top.select((F.row_number().over(Window.orderBy(F.desc("freq"), "token")) - 1).cast("long").alias("token_id"), "token")  # n rows


#: Tokens that break each rule, beside those of the documents.
TOKENS = ["the", "12", "1", "ab", "AAAAAA", "======", "NASA", "NaN", "<div>", "http://x", "x.com", "\\u00e9", "+-*/", "abcabcabc", "--x-", "aaBBccDD", "....", "😀😀😀", "é", "x" * 51, "Ġthe", "ok!", "?!?!", "__a__"]
_TOP, _KEPT = 3000, 1000


def _tokens(spark, sf_dir):
    """token_id, token: the most frequent words, then the hand-written tokens that are none of them."""
    top = top_words(spark, sf_dir, _TOP)
    extra = spark.createDataFrame([(_TOP + i, t) for i, t in enumerate(TOKENS)], "token_id long, token string")
    return top.unionByName(extra.join(top.select("token"), "token", "left_anti").select("token_id", "token"))


_ONE = "len(list_distinct(string_split(token, ''))) = 1"
_NO_ALNUM = "NOT regexp_matches(token, '[\\p{L}\\p{N}]')"
_RULE = f"""CASE WHEN length(token) > 50 THEN 'too_long' WHEN regexp_matches(token, '^\\p{{Nd}}{{2,}}$') THEN 'composite_number' WHEN length(token) >= 5 AND {_ONE} AND {_NO_ALNUM} THEN 'symbol_line'
 WHEN length(token) > 3 AND regexp_matches(token, '</?[a-z]{{2,}}[^>]*>|\\\\x[0-9A-Fa-f]{{2}}|https?://|\\.com') THEN 'html_or_code' WHEN length(token) >= 3 AND list_min(list_transform(string_split(token, ''), lambda c: unicode(c))) > 10000 THEN 'emoji_string'
 WHEN length(token) > 4 AND {_ONE} THEN 'repeated_characters' WHEN regexp_matches(token, '^[\\x00-\\x7F]*$') AND len(regexp_extract_all(token, '[A-Z]')) > 2 AND len(regexp_extract_all(token, '[a-z]')) > 2 THEN 'camelcase_noise'
 WHEN length(token) > 3 AND upper(token) = token AND lower(token) <> token THEN 'excessive_capital' WHEN regexp_matches(token, '\\\\u[0-9a-fA-F]{{4}}|\\\\x[0-9a-fA-F]{{2}}') THEN 'fake_unicode_esc'
 WHEN regexp_matches(token, '^[+\\-*/=<>^~]{{4,}}$') THEN 'garbage_maths' WHEN length(token) > 3 AND {_NO_ALNUM} AND NOT {_ONE} THEN 'mixed_punct' WHEN regexp_matches(token, '^[-_.]{{2,}}.+[-_.]+$') THEN 'bad_token_shape'
 WHEN len(list_filter(range(1, length(token) // 3 + 1), lambda k: length(token) % k = 0 AND repeat(left(token, CAST(k AS INT)), length(token) // k) = token)) > 0 THEN 'repeated_units' END"""
_LISTED = f"""top AS (SELECT row_number() OVER (ORDER BY freq DESC, token) - 1 AS token_id, token FROM (SELECT token, count(*) AS freq FROM (SELECT unnest({_WORDS}) AS token FROM documents) GROUP BY token ORDER BY freq DESC, token LIMIT {_TOP})),
 x(token_id, token) AS (VALUES {', '.join(f'({_TOP + i}, {literal(t)})' for i, t in enumerate(TOKENS))}), t AS (SELECT * FROM top UNION ALL SELECT * FROM x WHERE token NOT IN (SELECT token FROM top))"""


@query("vocab_suspicious", f"WITH {_LISTED} SELECT token, rule FROM (SELECT token, {_RULE} AS rule FROM t) WHERE rule IS NOT NULL")
def vocab_suspicious(spark, sf_dir):
    return _tokens(spark, sf_dir).select("token", K.suspicious(F.col("token")).alias("rule")).filter("rule is not null")


_SPECIAL = f"s(p, i, token) AS (VALUES {', '.join(f'(0, {i}, {literal(t)})' for i, t in enumerate(K.SPECIAL_TOKENS))}, {', '.join(f'(2, {i}, {literal(t)})' for i, t in enumerate(K.SPACING_TOKENS))})"


@query("vocab_clean", f"WITH {_LISTED}, {_SPECIAL}, k AS (SELECT 1 AS p, token_id AS i, token FROM t WHERE {_RULE} IS NULL AND token NOT IN (SELECT token FROM s) ORDER BY i LIMIT {_KEPT}) SELECT row_number() OVER (ORDER BY p, i) - 1 AS token_id, token FROM (SELECT * FROM s UNION ALL SELECT * FROM k)")
def vocab_clean(spark, sf_dir):
    return K.clean_vocab(_tokens(spark, sf_dir), len(K.SPECIAL_TOKENS) + len(K.SPACING_TOKENS) + _KEPT)


def _ids(spark, sf_dir):
    """A document's words as ids: their lengths stand for a vocabulary."""
    words = F.regexp_extract_all("text", F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))
    return table(spark, sf_dir, "documents").select("doc_id", F.transform(words, lambda w: F.length(w)).alias("ids"))


_D = f"d AS (SELECT doc_id, list_transform({_WORDS}, lambda w: length(w)) AS ids FROM documents), o AS (SELECT doc_id, ids, len(ids) + 1 AS n, sum(len(ids) + 1) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - len(ids) - 1 AS start FROM d)"


@query("pack_offsets", f"WITH {_D} SELECT doc_id, CAST(n AS BIGINT) AS n, CAST(start AS BIGINT) AS start FROM o")
def pack_offsets(spark, sf_dir):
    docs = _ids(spark, sf_dir).select("doc_id", (F.size("ids") + 1).cast("long").alias("n"))
    return P.offsets(docs, F.col("n"))


@query("pack_index", f"WITH {_D} SELECT CAST(s AS BIGINT) AS shard, CAST(sum(least(start + n, (s + 1) * {SHARD}) - greatest(start, s * {SHARD})) AS BIGINT) AS tokens FROM (SELECT *, unnest(range(CAST(start // {SHARD} AS BIGINT), CAST((start + n - 1) // {SHARD} AS BIGINT) + 1)) AS s FROM o) GROUP BY s")
def pack_index(spark, sf_dir):
    return P.shard_counts(pack_offsets(spark, sf_dir), F.col("n"), SHARD)


@query(
    "pack_shards",
    f"WITH {_D}, x AS (SELECT start, unnest(list_append(ids, 0)) AS id, unnest(range(0, n)) AS i FROM o) SELECT CAST((start + i) // {SHARD} AS BIGINT) AS shard, count(*) AS tokens, md5(string_agg(CAST(id AS VARCHAR), ',' ORDER BY start + i)) AS ids_md5 FROM x GROUP BY 1",
)
def pack_shards(spark, sf_dir):
    found = P.shards(_ids(spark, sf_dir), SHARD, 0)
    spelled = F.array_join(F.transform("tokens", lambda t: t.cast("string")), ",")
    return found.select("shard", F.size("tokens").cast("long").alias("tokens"), F.md5(spelled.cast("binary")).alias("ids_md5"))


@query(
    "frame_windows",
    f"WITH {_D}, x AS (SELECT start + i AS p, id FROM (SELECT start, unnest(list_append(ids, 0)) AS id, unnest(range(0, n)) AS i FROM o)), s AS (SELECT CAST(p // {SHARD} AS BIGINT) AS shard, list(id ORDER BY p) AS t FROM x GROUP BY 1), w AS (SELECT shard, t, unnest(range(0, (len(t) - 1) // {FRAME})) AS k FROM s WHERE len(t) > {FRAME}) SELECT shard, CAST(k AS BIGINT) AS frame, md5(array_to_string(t[k * {FRAME} + 1:k * {FRAME} + {FRAME}], ',')) AS x_md5, md5(array_to_string(t[k * {FRAME} + 2:k * {FRAME} + {FRAME} + 1], ',')) AS y_md5 FROM w",
)
def frame_windows(spark, sf_dir):
    """Next-token pairs of all frames; frames never cross shards."""
    frames = P.shards(_ids(spark, sf_dir), SHARD, 0).select("shard", F.posexplode(K.windows(F.col("tokens"), FRAME)).alias("frame", "w")).withColumn("p", K.next_tokens(F.col("w")))
    spelled = lambda x: F.md5(F.array_join(F.transform(x, lambda t: t.cast("string")), ",").cast("binary"))
    return frames.select("shard", F.col("frame").cast("long").alias("frame"), spelled("p.x").alias("x_md5"), spelled("p.y").alias("y_md5"))


_FRAMES = f"""x AS (SELECT start + i AS p, id FROM (SELECT start, unnest(list_append(ids, 0)) AS id, unnest(range(0, n)) AS i FROM o)), s AS (SELECT CAST(p // {SHARD} AS BIGINT) AS shard, list(id ORDER BY p) AS t FROM x GROUP BY 1),
 w AS (SELECT shard, k AS frame, t[k * {FRAME} + 1:k * {FRAME} + {FRAME} + 1] AS w FROM (SELECT shard, t, unnest(range(0, (len(t) - 1) // {FRAME})) AS k FROM s WHERE len(t) > {FRAME}))"""
BATCH = 8


@query(
    "train_batches",
    f"WITH {_D}, {_FRAMES}, r AS (SELECT *, row_number() OVER (ORDER BY md5('3:' || shard || ':' || frame)) - 1 AS spot, count(*) OVER () AS n FROM w) SELECT spot // {BATCH} AS batch, spot % {BATCH} AS slot, shard, CAST(frame AS BIGINT) AS frame, md5(array_to_string(w[:-2], ',')) AS x_md5, md5(array_to_string(w[2:], ',')) AS y_md5 FROM r WHERE spot < n // {BATCH} * {BATCH}",
)
def train_batches(spark, sf_dir):
    """Frames of all shards, shuffled, checked against the vocabulary's size, paired and dealt to whole batches."""
    frames = P.shards(_ids(spark, sf_dir), SHARD, 0).select("shard", F.posexplode(K.windows(F.col("tokens"), FRAME)).alias("frame", "w"))
    found = P.batches(frames, BATCH, 1 << 16, F.md5(F.concat_ws(":", F.lit("3"), F.col("shard").cast("string"), F.col("frame").cast("string"))))
    spelled = lambda x: F.md5(F.array_join(F.transform(x, lambda t: t.cast("string")), ",").cast("binary"))
    return found.select("batch", "slot", "shard", F.col("frame").cast("long").alias("frame"), spelled("x").alias("x_md5"), spelled("y").alias("y_md5"))


@query("index_totals", f"WITH {_D} SELECT CAST(count(*) AS BIGINT) AS shards, CAST(sum(n) AS BIGINT) AS tokens FROM (SELECT CAST((start + i) // {SHARD} AS BIGINT) AS shard, count(*) AS n FROM (SELECT start, unnest(range(0, n)) AS i FROM o) GROUP BY 1)")
def index_totals(spark, sf_dir):
    """An index of packed shards, written and read back, and its totals."""
    path = W.scratch(spark)
    pack_index(spark, sf_dir).select(F.concat(F.lit("packed_"), "shard").alias("path"), "tokens").write.json(path)
    return R.packed_index(spark, path).agg(F.countDistinct("path").alias("shards"), F.sum("tokens").alias("tokens"))


@query("chunk_balance", "SELECT doc_id, ntile(7) OVER (ORDER BY doc_id) - 1 AS chunk FROM documents")
def chunk_balance(spark, sf_dir):
    return P.chunks(table(spark, sf_dir, "documents").select("doc_id"), 7)


@query("batch_chunks", "SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 64 AS batch, (row_number() OVER (ORDER BY doc_id) - 1) % 64 AS place FROM documents")
def batch_chunks(spark, sf_dir):
    return P.batched(table(spark, sf_dir, "documents").select("doc_id"), 64)


IDS = {"user": 1001, "assistant": 1002, "system": 1003, "eos": 1004, "pad": 0}


def _dialogue_tokens(spark, sf_dir):
    rows = D.assemble(table(spark, sf_dir, "conversations"))
    words = lambda c: F.transform(F.regexp_extract_all(c, F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0)), lambda w: F.length(w))
    return rows.select("conv_id", F.transform("messages", lambda m: F.struct(m["role"].alias("role"), words(m["content"]).alias("tokens"))).alias("messages"))


@query(
    "sft_labels",
    f"WITH t AS (SELECT conv_id, role, CAST(len({_WORDS}) AS BIGINT) AS n FROM conversations) SELECT conv_id, CAST(sum(n + 2) AS BIGINT) AS real_tokens, CAST(sum(CASE WHEN role = 'assistant' THEN n + 1 ELSE 0 END) AS BIGINT) AS trained FROM t GROUP BY conv_id",
)
def sft_labels(spark, sf_dir):
    """Tokens and labels of whole dialogues, in sequences that are neither cut nor padded."""
    found = _dialogue_tokens(spark, sf_dir).select("conv_id", K.sft_labels(F.col("messages"), IDS, None).alias("x"))
    return found.select("conv_id", F.size(F.filter("x.attention_mask", lambda m: m == 1)).cast("long").alias("real_tokens"), F.size(F.filter("x.labels", lambda y: y != -100)).cast("long").alias("trained"))


@query(
    "prompt_ids",
    f"WITH t AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS back FROM conversations), k AS (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last FROM t WHERE NOT (back = 1 AND role = 'assistant')), i AS (SELECT conv_id, turn, role, text, list_concat(list_concat([CASE role WHEN 'user' THEN 1001 WHEN 'assistant' THEN 1002 ELSE 1003 END], list_transform({_WORDS}, lambda w: CAST(length(w) AS INT))), [CASE WHEN turn = last THEN 1002 ELSE 1004 END]) AS ids FROM k) SELECT conv_id, CAST(sum(len(ids)) AS BIGINT) AS n, md5(array_to_string(flatten(list(ids ORDER BY turn, role, text)), ',')) AS ids_md5 FROM i GROUP BY conv_id",
)
def prompt_ids(spark, sf_dir):
    """Dialogues without a last answer, as the ids that ask for it."""
    m = F.col("messages")
    asked = F.when(F.try_element_at(m, F.lit(-1))["role"] == "assistant", F.slice(m, F.lit(1), F.size(m) - 1)).otherwise(m)
    found = _dialogue_tokens(spark, sf_dir).withColumn("messages", asked).filter(F.size("messages") > 0).select("conv_id", K.prompt_ids(F.col("messages"), IDS).alias("ids"))
    return found.select("conv_id", F.size("ids").cast("long").alias("n"), F.md5(F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").cast("binary")).alias("ids_md5"))


ROOM = 512


def _fit(seed: int) -> str:
    """SQL of next fit within the parts of a seeded order: id, size, part, sequence, segment."""
    return f"""z{seed} AS (SELECT conv_id AS id, CAST(sum(len({_WORDS}) + 2) AS INT) AS size, md5('{seed}:' || conv_id) AS o FROM conversations GROUP BY conv_id),
 p{seed} AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY o, id) AS k FROM (SELECT *, ('0x' || substr(o, 1, 8))::BIGINT % greatest(8, CAST(ceil((SELECT count(*) FROM z{seed}) / 100000.0) AS BIGINT)) AS part FROM z{seed})),
 f{seed} AS (SELECT id, size, part, k, CASE WHEN size > {ROOM} THEN -1 ELSE 0 END AS sequence, 0 AS segment, 0 AS at, CASE WHEN size > {ROOM} THEN {ROOM} ELSE {ROOM} - size END AS free, CASE WHEN size > {ROOM} THEN 0 ELSE 1 END AS inside, CASE WHEN size > {ROOM} THEN 1 ELSE 0 END AS lost FROM p{seed} WHERE k = 1
 UNION ALL SELECT p.id, p.size, p.part, p.k, CASE WHEN p.size > {ROOM} THEN -1 WHEN p.size > f.free THEN f.at + 1 ELSE f.at END, CASE WHEN p.size > {ROOM} THEN f.lost WHEN p.size > f.free THEN 0 ELSE f.inside END,
   CASE WHEN p.size <= {ROOM} AND p.size > f.free THEN f.at + 1 ELSE f.at END, CASE WHEN p.size > {ROOM} THEN f.free WHEN p.size > f.free THEN {ROOM} - p.size ELSE f.free - p.size END,
   CASE WHEN p.size > {ROOM} THEN f.inside WHEN p.size > f.free THEN 1 ELSE f.inside + 1 END, CASE WHEN p.size > {ROOM} THEN f.lost + 1 ELSE f.lost END FROM f{seed} f JOIN p{seed} p ON p.part = f.part AND p.k = f.k + 1)"""


def _sizes(spark, sf_dir):
    return _dialogue_tokens(spark, sf_dir).select("conv_id", F.aggregate("messages", F.lit(0), lambda a, m: a + F.size(m["tokens"]) + 2).alias("size"))


@query("sft_next_fit", f"WITH RECURSIVE {_fit(0)} SELECT id, size, CAST(part AS INT) AS part, sequence, segment FROM f0")
def sft_next_fit(spark, sf_dir):
    return P.packed(_sizes(spark, sf_dir), ROOM, key="conv_id").select("id", "size", "part", "sequence", "segment")


@query("sft_steps", f"WITH RECURSIVE {_fit(0)}, u AS (SELECT count(*) AS examples, count(DISTINCT (part, sequence)) AS sequences FROM f0 WHERE sequence >= 0) SELECT examples, sequences, round(examples / greatest(1, sequences)::DOUBLE, 6) AS mean_packed, CAST(greatest(1, floor(examples / (examples / greatest(1, sequences)::DOUBLE * 4))) AS BIGINT) AS steps FROM u")
def sft_steps(spark, sf_dir):
    return P.steps(sft_next_fit(spark, sf_dir), 4)


_EPOCH = "SELECT {0} AS epoch, (before + sequence) // 4 AS batch, (before + sequence) % 4 AS slot, segment, id, size FROM f{0} JOIN (SELECT part, coalesce(sum(n) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT part, max(sequence) + 1 AS n FROM f{0} WHERE sequence >= 0 GROUP BY part)) USING (part) WHERE sequence >= 0"


@query("sft_batches", f"WITH RECURSIVE {_fit(1)}, {_fit(2)} SELECT epoch, CAST(batch AS BIGINT) AS batch, CAST(slot AS BIGINT) AS slot, segment, id, size FROM ({_EPOCH.format(1)} UNION ALL {_EPOCH.format(2)})")
def sft_batches(spark, sf_dir):
    """Two epochs of packed batches of four sequences."""
    return P.epoch_batches(_sizes(spark, sf_dir), ROOM, 4, 2, key="conv_id")


@query("length_bands", f"WITH t AS (SELECT conv_id, sum(len({_WORDS}) + 2) AS n FROM conversations GROUP BY conv_id) SELECT CASE WHEN n < 20 THEN 0 WHEN n < 60 THEN 1 WHEN n < 150 THEN 2 WHEN n < 300 THEN 3 WHEN n < 550 THEN 4 ELSE 5 END AS band, count(*) AS n FROM t GROUP BY 1")
def length_bands(spark, sf_dir):
    sizes = _dialogue_tokens(spark, sf_dir).select(F.aggregate("messages", F.lit(0), lambda a, m: a + F.size(m["tokens"]) + 2).alias("n"))
    band = F.when(F.col("n") < 20, 0).when(F.col("n") < 60, 1).when(F.col("n") < 150, 2).when(F.col("n") < 300, 3).when(F.col("n") < 550, 4).otherwise(5)
    return sizes.groupBy(band.alias("band")).agg(F.count("*").alias("n"))


@query("crawl_shuffle", "SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('7:' || doc_id), doc_id) AS place FROM documents")
def crawl_shuffle(spark, sf_dir):
    """A reproducible order of documents within a language."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    placed = ranges.hashed(docs, "_order", F.md5(F.concat(F.lit("7:"), F.col("doc_id").cast("string")).cast("binary")))
    return ranges.numbered(placed, ["_order", "doc_id"], ("lang",)).select("doc_id", "lang", "place")
