"""Queries that SQL cannot say, against plain Python over all rows of the table."""

import hashlib
import json
import math
import re
import unicodedata
import zlib
from collections import Counter

import pytest
import regex

from corpusloom.functions import answers, cleaning, filtering, foreign, quality, sentences, tokens
from corpusloom.plans import registry

TESTED = {
    "clean_moses", "clean_encoding", "html_text", "wiki_markup", "filter_compression", "filter_full_chain", "q_sentence_split", "q_flesch", "q_compression", "q_metrics",
    "documents_processed_whole", "pretok_counts", "bpe_merges", "encode_counts", "documents_tokenised", "m_repetition", "json_pretty",
}


def python(pattern):
    """A pattern of Java's as one of Python's."""
    pattern = re.sub(r"^\(\?[a-zA-Z]*[dU][a-zA-Z]*\)", "", pattern)
    return regex.compile(re.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), pattern))


def replaced(text, steps):
    for pattern, by in steps:
        text = python(pattern).sub(re.sub(r"\$(\d)", r"\\\1", by), text)
    return text


@pytest.fixture(scope="module")
def docs(spark, data):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{data}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def rows(spark, data):
    def run(name):
        return [r.asDict() for r in registry.queries()[name](spark, data).collect()]

    return run


def digest(text, before):
    return hashlib.md5(text.encode()).hexdigest(), len(text), text != before


def same_digests(found, key, texts):
    assert {r[key]: (r["cleaned_md5"], r["n"], r["changed"]) for r in found} == {k: digest(after, before) for k, (before, after) in texts.items()}


def test_moses(rows, docs):
    def clean(text, lang):
        out = replaced(text, cleaning.MOSES)
        if lang == "en":
            out = re.sub('"([,.]+)', r'\1"', out)
        mark = "." if lang not in ("de", "es", "cz", "cs", "fr") else ","
        return re.sub("([0-9])\u00a0([0-9])", rf"\1{mark}\2", out)

    same_digests(rows("clean_moses"), "doc_id", {k: (r["text"], clean(r["text"], r["lang"])) for k, r in docs.items()})


def test_encoding(rows, docs):
    same_digests(rows("clean_encoding"), "doc_id", {k: (r["text"], foreign.repaired(r["text"])) for k, r in docs.items()})


def test_html(spark, data, rows):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    same_digests(rows("html_text"), "page_id", {k: (t, foreign.html_to_text(t)) for k, t in pages.items()})


def test_wiki(rows, docs):
    texts = {}
    for k, r in docs.items():
        dressed = "{{Infobox|name={{PAGENAME}}}}\n'''" + r["source"] + "''' [[Lang|" + r["lang"] + "]]\n" + r["text"] + "<ref>x</ref>\n[[Category:All]]"
        plain = r["source"] + " " + r["lang"] + "\n" + r["text"]
        texts[k] = (dressed, foreign.wiki_to_text(dressed))
        if not re.search(r"[\[\]{}<>|']|\n{3}", r["text"]):
            assert texts[k][1] == plain.strip()
    same_digests(rows("wiki_markup"), "doc_id", texts)


def ratio(text):
    return len(text.encode()) / len(zlib.compress(text.encode()))


def test_compression(rows, docs):
    found = {r["doc_id"]: (r["ratio"], r["passed"]) for r in rows("filter_compression")}
    assert found == {k: (ratio(r["text"].strip()), ratio(r["text"].strip()) >= 1.1) for k, r in docs.items()}
    found = {r["doc_id"]: r["ratio"] for r in rows("q_compression")}
    assert found == {k: 1 / ratio(r["text"]) if r["text"] else 1.0 for k, r in docs.items()}


def bits(text):
    return -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values()) if text else 0.0


def reason(text, x=filtering.Limits()):
    t = text.strip()
    solid = [c for c in t if not c.isspace()]
    symbols = sum(unicodedata.category(c)[0] in "SP" for c in t)
    checks = [
        ("length", not max(1, x.min_chars) <= len(t) <= x.max_chars),
        ("word_count", len(t.split()) < x.min_words),
        ("sentence_count", len(python(filtering.SENTENCE).findall(t)) < x.min_sentences),
        ("entropy", bits(t) < x.min_entropy),
        ("symbol_ratio", not solid or symbols / len(solid) > x.max_symbol_ratio),
        ("compression", x.min_compression is not None and ratio(t) < x.min_compression),
        ("garbage", bool(re.search(filtering.HEX_RUN, t, re.A) or re.search(filtering.BIT_RUN, t, re.A))),
    ]
    return next((name for name, bad in checks if bad), None)


def test_full_chain(rows, docs):
    want = Counter(reason(r["text"]) or "pass" for r in docs.values())
    assert {r["reason"]: r["n"] for r in rows("filter_full_chain")} == want


def split(text, lang):
    """The heuristic, word by word."""
    if not text:
        return []
    for pattern in sentences.BREAKS:
        text = python(pattern).sub(r"\1\n\2", text)
    fixed, numeric = sentences.PREFIXES.get(lang, ([], []))
    fixed = set(fixed) - set(numeric)
    words, out = re.split(" +", text), []
    for i, word in enumerate(words):
        after = words[i + 1] if i + 1 < len(words) else ""
        end = python(sentences.WORD_END).search(word)
        cut = False
        if end and "." in word:
            bare = end[1] and not end[2]
            kept = bare and end[1] in fixed or python(sentences.ACRONYM).search(word)
            number = bare and end[1] in numeric and re.search(sentences.NUMBER, after)
            cut = bool(not kept and not number and python(sentences.STARTER).search(after))
        out.append(word + "\n" * cut)
    text = re.sub(" +", " ", " ".join(out)).replace("\n ", "\n").replace(" \n", "\n")
    return text.strip().split("\n")


def test_sentences(rows, docs):
    assert {r["doc_id"]: r["sentences"] for r in rows("q_sentence_split")} == {k: len(split(r["text"], r["lang"])) for k, r in docs.items()}


def ease(text, lang, n):
    words = regex.findall(r"\p{L}+", text)
    if lang not in ("en", "pt") or not words:
        return -1.0
    parts = sum(max(1, len(re.findall("[aeiouyáéíóúâêôãõàü]+", w.lower()))) for w in words)
    return round(206.835 - 1.015 * (len(words) / max(1, n)) - 84.6 * (parts / len(words)), 2)


def test_reading_ease(rows, docs):
    for r in rows("q_flesch"):
        d = docs[r["doc_id"]]
        assert r["score"] == pytest.approx(ease(d["text"], d["lang"], len(split(d["text"], d["lang"]))), abs=0.011)


def measured(text, lang):
    n, words = max(1, len(text)), regex.findall(quality.WORD, text)
    n_sentences = len(split(text, lang))
    listed = set(quality.STOPWORDS.get(lang, ()))
    stops = sum(w.lower() in listed for w in words) if lang in quality.STOPWORDS else None
    return {
        "entropy": bits(text),
        "sentence_count": n_sentences,
        "word_count": len(words),
        "mean_sentence_length": len(words) / max(1, n_sentences),
        "compression_ratio": 1 / ratio(text) if text else 1.0,
        "char_diversity": len(set(text)) / n,
        "symbol_ratio": len(regex.findall(r"[^\p{L}\p{N}\t\n\x0b\f\r ]", text)) / n,
        "repetition_percentage": len(re.findall(r"(.)\1{2,}", text)) / max(1, len(set(text))),
        "punctuation_anomalies": bool(re.search(r"([!?.,])\1{2,}", text)),
        "ascii_ratio": sum(c.isascii() for c in text) / n,
        "flesch_score": ease(text, lang, n_sentences),
        "stopword_ratio": None if stops is None else stops / max(1, len(words)),
        "stopword_coverage": None if stops is None else int(stops > 0),
    }


def same_metrics(row, want):
    for name, value in want.items():
        if isinstance(value, float):
            assert row[name] == pytest.approx(value, abs=0.011 if name == "flesch_score" else 1e-9), name
        else:
            assert row[name] == value, name


def test_metrics(rows, docs):
    for r in rows("q_metrics"):
        same_metrics(r, measured(docs[r["doc_id"]]["text"], docs[r["doc_id"]]["lang"]))


def test_documents_processed(rows, docs):
    steps = [s for name in cleaning.TEXT_STEPS for s in cleaning.TEXT_STEPS[name]]
    lists = {k: set(v) for k, v in {**quality.STOPWORDS, **quality.FUNCTION_WORDS}.items()}
    want = {}
    for k, r in docs.items():
        text = replaced(foreign.repaired(unicodedata.normalize("NFC", foreign.wiki_to_text("{{Box}} [[A|b]] " + r["text"]))), steps)
        hits = {x: sum(w.lower() in lists[x] for w in regex.findall(quality.WORD, text)) for x in sorted(lists)}
        lang = max(hits, key=lambda x: hits[x]) if any(hits.values()) else None
        if lang in ("en", "pt") and reason(text) is None:
            want[k] = (lang, hashlib.sha256(text.encode()).hexdigest(), text)
    found = {r["doc_id"]: r for r in rows("documents_processed_whole")}
    assert {k: (r["lang"], r["hash"]) for k, r in found.items()} == {k: x[:2] for k, x in want.items()}
    for k in sorted(want)[:40]:
        same_metrics(found[k], measured(want[k][2], want[k][0]))


LETTERS = tokens.byte_letters()


def pieces(text):
    return ["".join(LETTERS[b] for b in x.encode()) for x in python("|".join(tokens.PRE_TOKENS)).findall(text)]


@pytest.fixture(scope="module")
def counts(docs):
    return Counter(p for r in docs.values() for p in pieces(r["text"]))


def test_pre_tokens(rows, counts):
    assert {r["token"]: r["freq"] for r in rows("pretok_counts")} == counts


def test_merges(rows, counts):
    """The first merges one by one over all distinct tokens, counted anew each time."""
    found = [(r["left"], r["right"], r["freq"]) for r in sorted(rows("bpe_merges"), key=lambda r: r["step"])]
    assert len(found) == 1000 - 256 and len(set(found)) == len(found)
    words = [(list(w), n) for w, n in counts.items()]
    for left, right, freq in found[:25]:
        pairs = Counter()
        for w, n in words:
            for p in zip(w, w[1:]):
                pairs[p] += n
        best = min(pairs, key=lambda p: (-pairs[p], p))
        assert (left, right, freq) == (*best, pairs[best])
        for w, _ in words:
            i = 0
            while i < len(w) - 1:
                if (w[i], w[i + 1]) == best:
                    w[i : i + 2] = ["".join(best)]
                i += 1


def test_encoded(rows, docs):
    merges = [(r["left"], r["right"], r["freq"]) for r in sorted(rows("bpe_merges"), key=lambda r: r["step"])]
    vocab = set(LETTERS.values()) | {a + b for a, b, _ in merges}
    most, known = max(map(len, vocab)), {}

    def size(token):
        if token not in known:
            n = at = 0
            while at < len(token):
                at += next(k for k in range(min(most, len(token) - at), 0, -1) if token[at : at + k] in vocab)
                n += 1
            known[token] = n
        return known[token]

    want = {k: sum(map(size, pieces(r["text"]))) for k, r in docs.items() if r["text"]}
    assert {r["doc_id"]: r["tokens"] for r in rows("encode_counts")} == want
    for r in rows("documents_tokenised"):
        d = docs[r["doc_id"]]
        assert (r["id"], r["lang"], r["token_count"]) == (hashlib.sha256(d["text"].encode()).hexdigest(), d["lang"], want[r["doc_id"]])
        assert r["avg_chars_per_token"] == pytest.approx(len(d["text"]) / want[r["doc_id"]], abs=1e-6)


def test_repetition(spark, data, rows):
    turns = {(r["conv_id"], r["turn"]): r["text"] for r in spark.read.parquet(f"{data}/conversations.parquet").collect() if r["role"] == "assistant"}
    found = {(r["conv_id"], r["turn"]): (r["passed"], r["phrase"]) for r in rows("m_repetition")}
    assert set(found) == set(turns)
    for key, text in turns.items():
        words = regex.findall(r"[\p{L}\p{N}_]+(?:['’][\p{L}\p{N}_]+)?", text.lower())
        size, start, _ = answers.find_loop(words)
        assert found[key] == (size == 0, " ".join(words[start : start + size]) if size else None)


def test_pretty(spark, data, rows):
    for r in rows("json_pretty"):
        spelled = json.loads(r["json"])
        assert r["json"] == json.dumps(spelled, ensure_ascii=False, indent=2, sort_keys=True) and {"category", "language", "messages"} == set(spelled)
