import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from corpusloom.llm import line_dedup as L


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(docs, edits, least):
    lines = {}
    per = {}
    for key, text in docs:
        for i, line in enumerate((text or "").split("\n")):
            line = line.strip("\t\n\v\f\r ")
            if line:
                lines.setdefault(line, []).append((key, i))
                per.setdefault(key, []).append((i, line))
    names = sorted(lines)
    root = {x: x for x in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(names):
        for b in names[:i]:
            if min(len(a), len(b)) >= least and abs(len(a) - len(b)) <= edits and find(a) != find(b) and distance(a, b) <= edits:
                root[find(a)] = find(b)
    first = {}
    for x, at in lines.items():
        first[find(x)] = min(first.get(find(x), at[0]), *at)
    return {k: sorted(i for i, x in per.get(k, []) if first[find(x)] != (k, i)) for k, _ in docs}


def fixture(seed, n):
    r = random.Random(seed)
    base = ["".join(r.choice("abé ,") for _ in range(r.randint(8, 30))) for _ in range(12)]
    docs = []
    for k in range(n):
        out = []
        for _ in range(r.randint(0, 6)):
            x = list(r.choice(base))
            for _ in range(r.randint(0, 2)):
                at = r.randrange(len(x) + 1)
                kind = r.randrange(3)
                x[at : at + (kind > 0)] = [] if kind == 2 else [r.choice("abxyé")]
            out.append("".join(x))
        docs.append((k, "\n".join(out)))
    return docs


@pytest.mark.parametrize("edits,group,block", [(1, 32, 512), (1, 1, 2), (2, 32, 512), (2, 2, 3)])
def test_equals_brute_force(spark, monkeypatch, edits, group, block):
    monkeypatch.setattr(L, "BLOCK", block)  # small blocks, so that groups exceed them
    docs = fixture(edits * 10 + group, 60) + [(100, None), (101, ""), (102, "\n \n\t\n"), (103, "x" * 5000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = {r["_key"]: r["removed"] for r in L.removed_lines(df, edits=edits, min_chars=12, group=group).collect()}
    assert found == brute(docs, edits, 12)


def threshold(a, b, bands):
    return max(e for least, e in bands if max(len(a), len(b)) >= least)


@pytest.mark.parametrize("edits,group,block", [(((0, 1), (16, 2), (24, 3)), 32, 512), (((0, 1), (16, 2), (24, 3)), 1, 3), (2, 1, 512), (3, 3, 6)])
def test_thresholds_by_length(spark, monkeypatch, edits, group, block):
    monkeypatch.setattr(L, "BLOCK", block)
    docs = fixture(group + 7, 60)
    bands = ((0, edits),) if isinstance(edits, int) else edits
    lines = {x.strip("\t\n\v\f\r ") for _, t in docs for x in t.split("\n")} - {""}
    names = sorted(x for x in lines if len(x) >= 12)
    near = [(a, b) for i, a in enumerate(names) for b in names[:i] if abs(len(a) - len(b)) <= 3 and distance(a, b) <= threshold(a, b, bands)]
    root = {x: x for x in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in near:
        root[find(a)] = find(b)
    classes = {find(x) for x in names}
    df = spark.createDataFrame(docs, "doc_id long, text string")
    kept = [r for r in L.removed_lines(df, edits=edits, min_chars=12, group=group).collect()]
    left = [x.strip("\t\n\v\f\r ") for r in kept for i, x in enumerate(dict(docs)[r["_key"]].split("\n")) if i not in r["removed"]]
    left = [x for x in left if len(x) >= 12]
    assert len(left) == len(classes) and {find(x) for x in left} == classes


def test_two_typos_in_a_long_line(spark):
    line = " ".join(f"word{i * 37 % 101}" for i in range(30))
    docs = [(1, line), (2, line.replace("word37", "wird37").replace("word10", "worm10")), (3, line[:60]), (4, line[:30] + "x" + line[31:59])]
    found = {r["_key"]: r["removed"] for r in L.removed_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert found == {1: [], 2: [0], 3: [], 4: [0]}


def test_banded_distance():
    r = random.Random(5)
    a, b = [], []
    for _ in range(400):
        x = [r.choice("abc") for _ in range(r.randint(0, 12))]
        y = list(x)
        for _ in range(r.randint(0, 4)):
            at = r.randrange(len(y) + 1)
            y[at : at + r.randrange(2)] = [r.choice("abcé")] * r.randrange(2)
        a.append("".join(x))
        b.append("".join(y))
    for edits in (1, 2, 3):
        want = [distance(x, y) <= edits for x, y in zip(a, b)]
        assert L.within(pa.array(a), pa.array(b), edits).tolist() == want
        points = [[np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in c] for c in (a, b)]
        assert [L.within_far(x, y, edits) for x, y in zip(*points)] == want


def test_long_lines(spark):
    """Lines far beyond the length that is compared in bulk."""
    line = " ".join(f"word{i * i % 9973}" for i in range(4000))
    docs = [(1, line), (2, line[:9000] + "x" + line[9001:20000] + line[20001:]), (3, "y" + line[:-3]), (4, line[:100] + "abcd" + line[104:]), (5, line[5:])]
    found = {r["_key"]: r["removed"] for r in L.removed_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert found == {1: [], 2: [0], 3: [], 4: [], 5: []}


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert L.removed_lines(empty).count() == 0
    line = "the same line, more than twenty characters"
    docs = [(2, f"a\n{line}", 7), (1, line, 8), (None, line, 9), (1, line, 8)]
    # further columns, and such whose names the operator uses itself
    df = spark.createDataFrame([(*x, "r", 1, "k", 5, 6) for x in docs], "doc_id long, text string, n_lines int, removed string, copies int, _key string, text_hash int, kept int")
    found = sorted((r["doc_id"] or 99, r["text"], r["n_lines"], r["removed"], r["kept"]) for r in L.deduplicated(df).collect())
    assert found == [(1, line, 8, "r", 6), (1, line, 8, "r", 6), (2, "a", 7, "r", 6), (99, "", 9, "r", 6)]
    gone = {(r["_key"], r["copies"]): r["removed"] for r in L.removed_lines(df).collect()}
    assert gone == {(1, 2): [], (2, 1): [1], ((1 << 63) - 1, 1): [0]}


def test_query_digest(spark, data):
    """The query's columns follow from the operator's, for every row."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    removed = {r["_key"]: (r["n_lines"], r["removed"]) for r in L.removed_lines(docs).collect()}
    rows = L.op3_line_dedup(spark, data).collect()
    assert len(rows) == docs.count()
    for r in rows:
        n, gone = removed[r["doc_id"]]
        assert (r["n_lines"], r["n_removed"]) == (n, len(gone))
        assert r["removed_sha256"] == hashlib.sha256(",".join(map(str, gone)).encode()).hexdigest()


def test_lines_of_one_kind_in_a_third_of_all_documents(spark):
    line = "this very line stands in every third document of all, word for word"
    docs = [(k, f"own line number {k * 7919} of the document\n" + (line if k % 3 == 0 else line[:-4] + f"w{k % 7}rd") if k % 3 < 2 else f"nothing {k} shared") for k in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = {r["_key"]: r["removed"] for r in L.removed_lines(df, edits=2, group=4).collect()}
    assert found == brute(docs, 2, 0)


@pytest.mark.parametrize("most", [1 << 22, 40])
def test_entries_travel_packed(monkeypatch, most):
    """Many entries to a row; pairs, and large keys whose lines go out as they come, whatever a task holds at a time."""
    monkeypatch.setattr(L, "_HELD", most)
    r = np.random.default_rng(3)
    names = L.W.mix(np.arange(1, 400, dtype=np.uint64))
    key = names[np.concatenate([r.integers(0, 398, 3000), np.full(500, 7), np.full(300, 398)])]
    line = r.integers(0, 1 << 40, len(key))
    line[r.random(len(key)) < 0.2] |= L._INDEX
    line[-300:] &= ~L._INDEX  # a large key without an index entry
    key, line = np.append(key, key[:200]), np.append(line, line[:200])  # equal entries
    batches = [L._packed(key[at : at + 900], line[at : at + 900], 3) for at in range(0, len(key), 900)]
    assert sum(x.num_rows for x in batches) <= 6 * len(batches)
    dealt = pa.Table.from_batches(batches).sort_by([("part", "ascending"), ("probe", "ascending")]).to_batches(max_chunksize=2)
    pairs, large = set(), set()
    for x in L._runs(12)(iter(dealt)):
        for k, a, b in zip(*[x.column(c).to_pylist() for c in ("key", "a", "b")], strict=True):
            (large.add((k, a)) if b is None else pairs.add((a, b)))
    of = {}
    for k, x in zip(key.view(np.int64).tolist(), line.tolist(), strict=True):
        of.setdefault(k, set()).add(x)
    bare = int(~L._INDEX)
    some = {k: v for k, v in of.items() if min(v) < 0}
    assert large == {(k, x & bare) for k, v in some.items() if len(v) > 12 for x in v} and len(some) < len(of)
    want = {tuple(sorted((a & bare, b & bare))) for v in some.values() if len(v) <= 12 for a in v if a < 0 for b in v if a & bare != b & bare}
    assert pairs == want and want


def test_lines_are_named_by_their_bytes():
    texts = [" é日本 line \r\n\n\t\nsecond", None, "", "\x85x\n \x0bsecond\x0c", "日" * 30]
    (_, x), = L.line_chunks(pa.array(texts))
    want = [(i, k, y) for i, t in enumerate(texts) for k, y in enumerate(s.strip("\t\n\v\f\r ") for s in (t or "").split("\n")) if y]
    assert list(zip(x.row.tolist(), x.number.tolist(), x.words(np.arange(len(x.row))).to_pylist(), strict=True)) == want
    assert x.size.tolist() == [len(y) for _, _, y in want]
    assert [a == b for a in x.hash.tolist() for b in x.hash.tolist()] == [a == b for _, _, a in want for _, _, b in want]
