"""Cleaning, filters, quality metrics and exact dedup over documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cleaning, filtering, foreign, quality, sentences
from .base import duck_replace, literal, query, table


def _digest(df, key, cleaned, text):
    return df.select(key, F.md5(F.encode(cleaned, "UTF-8")).alias("cleaned_md5"), F.length(cleaned).cast("long").alias("n"), (cleaned != F.col(text)).alias("changed"))


def _digest_sql(key, name, cleaned, text):
    return f"SELECT {key}, md5(c) AS cleaned_md5, CAST(length(c) AS BIGINT) AS n, c <> {text} AS changed FROM (SELECT {key}, {text}, {cleaned} AS c FROM {name})"


def _register_steps():
    for name, steps in cleaning.TEXT_STEPS.items():

        @query(f"clean_{name}", _digest_sql("doc_id", "documents", duck_replace("text", steps), "text"))
        def run(spark, sf_dir, f=cleaning.STEPS[name]):
            return _digest(table(spark, sf_dir, "documents"), "doc_id", f(F.col("text")), "text")

    for name, steps in cleaning.HTML_STEPS.items():

        @query(f"clean_{name}", _digest_sql("page_id", "pages", duck_replace("html", steps), "html"))
        def run_html(spark, sf_dir, f=cleaning.STEPS[name]):
            return _digest(table(spark, sf_dir, "pages"), "page_id", f(F.col("html")), "html")


_register_steps()
_ALL_TEXT = [s for x in cleaning.TEXT_STEPS.values() for s in x]
_ALL_HTML = [s for x in cleaning.HTML_STEPS.values() for s in x]


@query("clean_text_chain", _digest_sql("doc_id", "documents", duck_replace("nfc_normalize(text)", _ALL_TEXT), "text"))
def clean_text_chain(spark, sf_dir):
    """The whole chain.  SQL has no encoding repair, which leaves texts without such damage as they are."""
    docs = table(spark, sf_dir, "documents").withColumn("c", cleaning.clean_text(F.col("text")))
    return _digest(docs, "doc_id", F.col("c"), "text")


@query("clean_html_chain", _digest_sql("page_id", "pages", duck_replace("html", _ALL_HTML), "html"))
def clean_html_chain(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").withColumn("c", cleaning.clean_html(F.col("html")))
    return _digest(pages, "page_id", F.col("c"), "html")


@query("clean_squeeze", _digest_sql("doc_id", "documents", "regexp_replace(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '\\s+', ' ', 'g')", "text"))
def clean_squeeze(spark, sf_dir):
    return _digest(table(spark, sf_dir, "documents"), "doc_id", cleaning.squeeze(F.col("text")), "text")


@query("clean_moses")
def clean_moses(spark, sf_dir):
    return _digest(table(spark, sf_dir, "documents"), "doc_id", cleaning.moses_punctuation(F.col("text"), F.col("lang")), "text")


@query("clean_unicode", "SELECT doc_id, md5(c) AS cleaned_md5, CAST(length(c) AS BIGINT) AS n, c <> text AS changed FROM (SELECT doc_id, text, nfc_normalize(text) AS c FROM documents)")
def clean_unicode(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("c", foreign.unicode_form("NFC")("text"))
    return _digest(docs, "doc_id", F.col("c"), "text")


@query("clean_encoding")
def clean_encoding(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("c", foreign.fix_encoding("text"))
    return _digest(docs, "doc_id", F.col("c"), "text")


@query("html_text")
def html_text(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").withColumn("c", foreign.html_text("html"))
    return _digest(pages, "page_id", F.col("c"), "html")


@query("wiki_markup")
def wiki_markup(spark, sf_dir):
    """Documents dressed as wiki pages, and their text again."""
    dressed = F.concat(F.lit("{{Infobox|name={{PAGENAME}}}}\n'''"), "source", F.lit("''' [[Lang|"), "lang", F.lit("]]\n"), F.coalesce("text", F.lit("")), F.lit("<ref>x</ref>\n[[Category:All]]"))
    docs = table(spark, sf_dir, "documents").select("doc_id", dressed.alias("wiki")).withColumn("c", foreign.wiki_text("wiki"))
    return _digest(docs, "doc_id", F.col("c"), "wiki")


@query("title_names", "SELECT page_id, trim(regexp_replace(url, '[^A-Za-z0-9]+', '_', 'g'), '_') AS title FROM pages")
def title_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", foreign.titles(F.col("url")).alias("title"))


# Filters. DuckDB has no back-references or look-around, which these do not use.
_STRIP = "trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_WORDS = f"CAST(len(list_filter(regexp_split_to_array({_STRIP}, '\\s+'), lambda w: w <> '')) AS BIGINT)"
_SENTENCES = f"CAST(len(regexp_extract_all({_STRIP}, {literal(filtering.SENTENCE)})) AS BIGINT)"
_ENTROPY = "-list_sum(list_transform(map_values(list_histogram(string_split(t, ''))), lambda n: n / length(t)::DOUBLE * log2(n / length(t)::DOUBLE)))"
_SYMBOLS = "CAST(len(regexp_extract_all(regexp_replace(t, '\\s+', '', 'g'), '[\\p{S}\\p{P}]')) AS BIGINT)"
_BARE = "CAST(length(regexp_replace(t, '\\s+', '', 'g')) AS BIGINT)"
_GARBAGE = f"(regexp_matches(t, {literal(filtering.HEX_RUN)}) OR regexp_matches(t, {literal(filtering.BIT_RUN)}))"
_FROM = f"FROM (SELECT doc_id, lang, source, {_STRIP} AS t, {_WORDS} AS words, {_SENTENCES} AS sentences FROM documents)"


def _stripped(spark, sf_dir):
    return table(spark, sf_dir, "documents").withColumn("t", cleaning.strip(F.col("text")))


@query("filter_length", f"SELECT doc_id, length(t) BETWEEN 200 AND 1000000 AS passed {_FROM}")
def filter_length(spark, sf_dir):
    return _stripped(spark, sf_dir).select("doc_id", F.length("t").between(200, 1_000_000).alias("passed"))


@query("filter_word_count", f"SELECT doc_id, words, words >= 30 AS passed {_FROM}")
def filter_word_count(spark, sf_dir):
    n = filtering.n_words(F.col("t")).cast("long")
    return _stripped(spark, sf_dir).select("doc_id", n.alias("words")).withColumn("passed", F.col("words") >= 30)


@query("filter_sentence_count", f"SELECT doc_id, sentences, sentences >= 3 AS passed {_FROM}")
def filter_sentence_count(spark, sf_dir):
    return _stripped(spark, sf_dir).select("doc_id", filtering.sentences(F.col("t")).cast("long").alias("sentences")).withColumn("passed", F.col("sentences") >= 3)


@query("filter_entropy", f"SELECT doc_id, CASE WHEN t = '' THEN FALSE ELSE round({_ENTROPY}, 6) >= 3.0 END AS passed {_FROM}")
def filter_entropy(spark, sf_dir):
    return _stripped(spark, sf_dir).select("doc_id", (F.round(filtering.entropy(F.col("t")), 6) >= 3.0).alias("passed"))


@query("filter_symbol_ratio", f"SELECT doc_id, {_SYMBOLS} AS symbols, {_BARE} AS bare, CASE WHEN {_BARE} = 0 THEN FALSE ELSE {_SYMBOLS} / {_BARE}::DOUBLE <= 0.3 END AS passed {_FROM}")
def filter_symbol_ratio(spark, sf_dir):
    found = _stripped(spark, sf_dir).select("doc_id", filtering.n_symbols(F.col("t")).cast("long").alias("symbols"), filtering.n_solid(F.col("t")).cast("long").alias("bare"))
    return found.withColumn("passed", (F.col("bare") > 0) & (F.col("symbols") / F.greatest(F.lit(1), F.col("bare")) <= 0.3))


@query("filter_garbage", f"SELECT doc_id, NOT {_GARBAGE} AS passed {_FROM}")
def filter_garbage(spark, sf_dir):
    return _stripped(spark, sf_dir).select("doc_id", (~filtering.garbage(F.col("t"))).alias("passed"))


_STOPS = "[" + ", ".join(literal(w) for w in sorted(set(quality.STOPWORDS["en"]))) + "]"


@query(
    "filter_stopword_ratio",
    f"SELECT doc_id, hits, words, CASE WHEN words = 0 THEN FALSE ELSE hits / words::DOUBLE BETWEEN 0.01 AND 0.8 END AS passed FROM (SELECT doc_id, words, CAST(len(list_filter(regexp_split_to_array(t, '\\s+'), lambda w: w <> '' AND list_contains({_STOPS}, lower(w)))) AS BIGINT) AS hits {_FROM})",
)
def filter_stopword_ratio(spark, sf_dir):
    known = F.array(*[F.lit(w) for w in sorted(set(quality.STOPWORDS["en"]))])
    words = _stripped(spark, sf_dir).select("doc_id", filtering.words(F.col("t")).alias("w"))
    words = words.select("doc_id", F.size(F.filter("w", lambda x: F.array_contains(known, F.lower(x)))).cast("long").alias("hits"), F.size("w").cast("long").alias("words"))
    return words.withColumn("passed", F.when(F.col("words") > 0, (F.col("hits") / F.col("words")).between(0.01, 0.8)).otherwise(False))


_REASON = f"""CASE WHEN NOT length(t) BETWEEN 200 AND 1000000 THEN 'length' WHEN words < 30 THEN 'word_count' WHEN sentences < 3 THEN 'sentence_count'
 WHEN round({_ENTROPY}, 6) < 3.0 THEN 'entropy' WHEN {_SYMBOLS} / {_BARE}::DOUBLE > 0.3 THEN 'symbol_ratio' WHEN {_GARBAGE} THEN 'garbage' END"""
_NATIVE = filtering.Limits(min_compression=None)


@query("filter_reject_reason", f"SELECT coalesce({_REASON}, 'pass') AS reason, count(*) AS n, CAST(sum(length(t)) AS BIGINT) AS chars {_FROM} GROUP BY 1")
def filter_reject_reason(spark, sf_dir):
    """How many documents each filter of the native chain rejects first."""
    docs = filtering.with_reason(_stripped(spark, sf_dir), "t", _NATIVE).select(F.coalesce("reason", F.lit("pass")).alias("reason"), F.length("t").alias("k"))
    return docs.groupBy("reason").agg(F.count("*").alias("n"), F.sum("k").cast("long").alias("chars"))


@query("filter_rejected_documents", f"SELECT doc_id, {_REASON} AS reason {_FROM} WHERE {_REASON} IS NOT NULL")
def filter_rejected_documents(spark, sf_dir):
    return filtering.with_reason(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", _NATIVE).filter("reason is not null").select("doc_id", "reason")


@query("filter_compression")
def filter_compression(spark, sf_dir):
    return _stripped(spark, sf_dir).select("doc_id", filtering.bytes_over_compressed("t").alias("ratio")).withColumn("passed", F.col("ratio") >= 1.1)


@query("filter_full_chain")
def filter_full_chain(spark, sf_dir):
    docs = filtering.with_reason(table(spark, sf_dir, "documents").select("text"))
    return docs.groupBy(F.coalesce("reason", F.lit("pass")).alias("reason")).agg(F.count("*").alias("n"))


@query("filter_languages", "SELECT doc_id, lang FROM documents WHERE lang IN ('en', 'pt')")
def filter_languages(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(F.col("lang").isin("en", "pt")).select("doc_id", "lang")


@query("extract_floor", f"SELECT doc_id, sha256(s) AS id, CAST(length(s) AS BIGINT) AS n FROM (SELECT doc_id, regexp_replace({_STRIP}, '\\s+', ' ', 'g') AS s FROM documents) WHERE length(s) >= 100")
def extract_floor(spark, sf_dir):
    """Squeezed documents of 100 characters or more, named by their hash."""
    docs = table(spark, sf_dir, "documents").select("doc_id", cleaning.squeeze(F.col("text")).alias("s")).filter(F.length("s") >= 100)
    return docs.select("doc_id", F.sha2("s", 256).alias("id"), F.length("s").cast("long").alias("n"))


# Quality.
@query("q_entropy", f"SELECT doc_id, round({_ENTROPY.replace('(t', '(text')}, 6) AS entropy FROM (SELECT doc_id, text, text AS t FROM documents) WHERE text <> ''")
def q_entropy(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter("text <> ''").select("doc_id", F.round(filtering.entropy(F.col("text")), 6).alias("entropy"))


@query("q_char_diversity", "SELECT doc_id, CAST(len(list_distinct(string_split(text, ''))) AS BIGINT) AS distinct_chars, CAST(length(text) AS BIGINT) AS chars FROM documents WHERE text <> ''")
def q_char_diversity(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter("text <> ''").select("doc_id", F.round(quality.char_diversity(F.col("text")) * F.length("text"), 0).cast("long").alias("distinct_chars"), F.length("text").cast("long").alias("chars"))


@query("q_symbol_ratio", "SELECT doc_id, round(len(regexp_extract_all(text, '[^\\p{L}\\p{N}\\s]')) / greatest(1, length(text))::DOUBLE, 6) AS ratio FROM documents")
def q_symbol_ratio(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(quality.symbol_ratio(F.col("text")), 6).alias("ratio"))


@query("q_ascii_ratio", "SELECT doc_id, round(len(regexp_extract_all(text, '[\\x00-\\x7F]')) / greatest(1, length(text))::DOUBLE, 6) AS ratio FROM documents")
def q_ascii_ratio(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(quality.ascii_ratio(F.col("text")), 6).alias("ratio"))


@query("q_punct_anomaly", "SELECT doc_id, regexp_matches(text, '!{3,}|\\?{3,}|\\.{3,}|,{3,}') AS anomaly FROM documents")
def q_punct_anomaly(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", quality.punctuation_anomaly(F.col("text")).alias("anomaly"))


_QW = "regexp_extract_all(text, '[\\p{L}\\p{M}\\p{N}_]+')"


@query("q_word_count", f"SELECT doc_id, CAST(len({_QW}) AS BIGINT) AS words FROM documents")
def q_word_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(quality.word_list(F.col("text"))).cast("long").alias("words"))


@query("q_stopword_ratio", f"SELECT doc_id, CASE WHEN lang = 'en' THEN round(len(list_filter({_QW}, lambda w: list_contains({_STOPS}, lower(w)))) / greatest(1, len({_QW}))::DOUBLE, 6) END AS ratio FROM documents")
def q_stopword_ratio(spark, sf_dir):
    hits = quality.stopword_hits(F.col("text"), F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", F.round(hits / F.greatest(F.lit(1), F.size(quality.word_list(F.col("text")))), 6).alias("ratio"))


_TRIPLE = "CASE WHEN regexp_matches(c, '[\\p{L}\\p{M}\\p{N} ]') THEN '[' || c || ']{3,}' ELSE '[\\' || c || ']{3,}' END"


@query(
    "q_repetition",
    # RE2 has no back-references: runs of three equal characters or more, by each character that is in the text three times over
    f"SELECT doc_id, round(coalesce(list_sum(list_transform(list_filter(list_distinct(string_split(text, '')), lambda c: c <> chr(10) AND contains(text, c || c || c)), lambda c: len(regexp_extract_all(text, {_TRIPLE})))), 0) / greatest(1, len(list_distinct(string_split(text, ''))))::DOUBLE, 6) AS ratio FROM documents",
)
def q_repetition(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(quality.repetition(F.col("text")), 6).alias("ratio"))


@query("q_sentence_split")
def q_sentence_split(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(sentences.split_sentences(F.col("text"), F.col("lang"))).alias("sentences"))


@query("q_flesch")
def q_flesch(spark, sf_dir):
    n = F.size(sentences.split_sentences(F.col("text"), F.col("lang")))
    return table(spark, sf_dir, "documents").select("doc_id", quality.reading_ease(F.col("text"), F.col("lang"), n).alias("score"))


@query("q_compression")
def q_compression(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", quality.compression_ratio(F.col("text")).alias("ratio"))


@query("q_metrics")
def q_metrics(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", quality.metrics(F.col("text"), F.col("lang")).alias("m")).select("doc_id", "m.*")


_LISTS = {**quality.STOPWORDS, **quality.FUNCTION_WORDS}
_LANGS = sorted(_LISTS)
_SCORED = ", ".join(f"len(list_filter(w, lambda x: list_contains([{', '.join(map(literal, sorted(set(_LISTS[x]))))}], lower(x)))) AS h_{x}" for x in _LANGS)
_MOST = "greatest(" + ", ".join(f"h_{x}" for x in _LANGS) + ")"
DETECTED = f"CASE WHEN {_MOST} = 0 THEN NULL " + " ".join(f"WHEN h_{x} = {_MOST} THEN '{x}'" for x in _LANGS) + " END"


def scored(name: str) -> str:
    return f"(SELECT *, {_SCORED} FROM (SELECT *, {_QW} AS w FROM {name}))"


@query("q_language", f"SELECT lang, {DETECTED} AS detected, count(*) AS n FROM {scored('documents')} GROUP BY ALL")
def q_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("lang", quality.detected_language(F.col("text")).alias("detected"))
    return docs.groupBy("lang", "detected").agg(F.count("*").alias("n"))


@query(
    "quality_by_label",
    f"SELECT l.quality, coalesce({_REASON}, 'pass') AS reason, count(*) AS n, grouping(coalesce({_REASON}, 'pass')) = 1 AS overall FROM (SELECT doc_id, {_STRIP} AS t, {_WORDS} AS words, {_SENTENCES} AS sentences FROM documents) d JOIN labels l USING (doc_id) GROUP BY GROUPING SETS ((l.quality), (l.quality, coalesce({_REASON}, 'pass')))".replace(
        f"coalesce({_REASON}, 'pass') AS reason, count(*) AS n, grouping(coalesce({_REASON}, 'pass')) = 1", "reason, count(*) AS n, grouping(reason) = 1"
    ).replace(f"FROM (SELECT doc_id, {_STRIP} AS t, {_WORDS} AS words, {_SENTENCES} AS sentences FROM documents) d", f"FROM (SELECT doc_id, coalesce({_REASON}, 'pass') AS reason {_FROM}) d").replace(f"(l.quality, coalesce({_REASON}, 'pass'))", "(l.quality, reason)"),
)
def quality_by_label(spark, sf_dir):
    """Documents by label and reject reason, with a total for each label."""
    labelled = table(spark, sf_dir, "documents").select("doc_id", "text").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    found = filtering.with_reason(labelled, "text", _NATIVE).select("quality", F.coalesce("reason", F.lit("pass")).alias("reason"))
    return found.groupingSets([["quality"], ["quality", "reason"]], "quality", "reason").agg(F.count("*").alias("n"), (F.grouping("reason") == 1).alias("overall"))


# Hashes and exact dedup.
@query("hash_documents", "SELECT doc_id, sha256(text) AS hash FROM documents")
def hash_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))


@query("ids_md5", "SELECT page_id, md5(url) AS id, md5(html) AS hash FROM pages")
def ids_md5(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5("url").alias("id"), F.md5("html").alias("hash"))


@query("dedup_exact_groups", "SELECT sha256(text) AS hash, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def dedup_exact_groups(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    return docs.groupBy("hash").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).filter("copies > 1")


@query("dedup_keep_first", "SELECT doc_id, lang, source, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS k FROM documents) WHERE k = 1")
def dedup_keep_first(spark, sf_dir):
    """The first document of each text; a partial aggregate meets copies before the shuffle."""
    docs = table(spark, sf_dir, "documents")
    first = docs.groupBy(F.sha2("text", 256).alias("hash")).agg(F.min(F.struct("doc_id", "lang", "source", "n_chars")).alias("x"))
    return first.select("x.*")


@query("dedup_by_source", "WITH g AS (SELECT sha256(text) AS h, count(*) AS n FROM documents GROUP BY 1) SELECT source, count(*) AS docs, sum(CASE WHEN n > 1 THEN 1 ELSE 0 END)::BIGINT AS in_groups FROM (SELECT source, sha256(text) AS h FROM documents) JOIN g USING (h) GROUP BY source")
def dedup_by_source(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", F.sha2("text", 256).alias("h"))
    per = docs.groupBy("h", "source").agg(F.count("*").alias("k"))
    groups = per.groupBy("h").agg(F.sum("k").alias("n"))
    return per.join(groups, "h").groupBy("source").agg(F.sum("k").alias("docs"), F.sum(F.when(F.col("n") > 1, F.col("k")).otherwise(0)).alias("in_groups"))


@query(
    "dedup_source_pairs",
    "WITH g AS (SELECT DISTINCT sha256(text) AS h, source FROM documents) SELECT a.source AS source_a, b.source AS source_b, count(*) AS shared FROM g a JOIN g b ON a.h = b.h AND a.source < b.source GROUP BY ALL",
)
def dedup_source_pairs(spark, sf_dir):
    """Texts that two sources share: distinct (text, source) first, so a text pairs sources and never copies."""
    g = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("h"), "source").distinct()
    g = g.groupBy("h").agg(F.array_sort(F.collect_set("source")).alias("s")).filter(F.size("s") > 1)
    pairs = F.flatten(F.transform("s", lambda a, i: F.transform(F.slice("s", i + 2, F.size("s")), lambda b: F.struct(a.alias("source_a"), b.alias("source_b")))))
    return g.select(F.explode(pairs).alias("p")).groupBy("p.source_a", "p.source_b").agg(F.count("*").alias("shared"))
