"""N-gram Jaccard join by a token-group matrix.

A document's set holds the hashes of its distinct word shingles; equal sets are
one node.  Two nodes link when the Jaccard similarity of their sets reaches
``percent`` hundredths.

Shingles have one global order, frequent ones last.  Nodes that link have at
least k(n) shingles in common among the first ones of both (the prefix), so
nodes with fewer shingles that any other node's prefix has are done.  The rest
are partitioned into groups of similar nodes, by their most frequent prefix
shingle, and groups are cut into blocks of bounded size.

1. Within a block, and between a block and the most typical node of its group,
   all nodes are compared, but for those already connected.
2. Connected nodes form a class.  The matrix holds, for each class (and for the
   single nodes of a block), the union of its prefixes.  The overlap of a node
   with a union bounds its overlap with every member; only where the bound
   qualifies is the class opened and its members are compared, again but for
   those already connected.

So no pair within a group of copies is ever a row: a task returns the edges
that connect classes, and the frequent shingles of a shared passage or a family
of copies meet in one group.

Which shingles are frequent is estimated while the sets are made: each task keeps
the counts of the shingles it sees most, and lowers all when it has too many, so
what is anywhere near a share of one in ``COUNTED`` of a task's shingles is found,
however thinly it is spread.  The estimate steers the order alone, not the result.

Cases: null and empty texts and texts without words have no shingles and link
with nothing; equal sets always link; a null doc_id comes last and stands as
null; repeated rows each give a row; an empty table gives no rows; a very long
text is one set; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tables as T
from . import words as W
from .components import components

SHINGLE, PERCENT = 4, 85
#: Frequent shingles that come last: at most so many, seen at least so often.  A task names those it sees so often, and
#: counts so many at a time.
MOST_FREQUENT, LEAST_SEEN, LEAST_IN_TASK, COUNTED = 500_000, 64, 8, 200_000
BLOCK_NODES, BLOCK_SHINGLES, QUERIES = 256, 2_000_000, 2_000
#: Rows of a shingle that meet the matrix in one place.
SHARED = 1_000


def least_overlap(n, percent: int):
    return (percent * n + 99) // 100


def extra(n):
    """k(n): shingles in common that both prefixes of linked nodes have at least."""
    return 1 + n * 3 // 100


def prefix_size(n, percent: int):
    return n - least_overlap(n, percent) + np.minimum(extra(n), least_overlap(n, percent))


class Sets:
    """The distinct shingles of each row of a chunk, sorted by row and hash."""

    def __init__(self, chunk: W.Chunk, shingle: int):
        grams, valid = chunk.grams(shingle)
        rows = chunk.row_of_word()
        short = np.flatnonzero((chunk.counts > 0) & (chunk.counts < shingle))
        if len(short):
            whole = W.run_hash(W.runs(chunk.hash, 3), chunk.first[short], chunk.first[short + 1])
            values, rows = np.concatenate([grams[valid], whole]), np.concatenate([rows[valid], short])
        else:
            values, rows = grams[valid], rows[valid]
        order = np.lexsort((values, rows))
        values, rows = values[order], rows[order]
        new = np.ones(len(values), bool)
        new[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
        self.values, self.rows = values[new], rows[new]
        self.sizes = np.bincount(self.rows, minlength=chunk.rows)
        self.ends = np.cumsum(self.sizes)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(W.mix(self.values ^ np.uint64(0x5DEECE66D)))])
        self.name = W.mix(sums[self.ends] - sums[self.ends - self.sizes] + self.sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _prefixes(s: Sets, frequent: np.ndarray, percent: int) -> np.ndarray:
    """Which shingles are in their row's prefix, frequent ones last."""
    if len(frequent):
        late = frequent[np.minimum(np.searchsorted(frequent, s.values), len(frequent) - 1)] == s.values
    else:
        late = np.zeros(len(s.values), bool)
    order = np.lexsort((s.values, late, s.rows))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order)) - np.repeat(s.ends - s.sizes, s.sizes)
    return place < np.repeat(prefix_size(s.sizes, percent), s.sizes)


class _Seen:
    """The most frequent values of a stream, with counts that are too low by a bounded share of its length at most."""

    def __init__(self, most: int = COUNTED):
        self.most, self.held, self.size = most, [], 0
        self.values, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, values: np.ndarray) -> None:
        self.held.append(values)
        self.size += len(values)
        if self.size > 4 * self.most:
            self.settle()

    def settle(self) -> None:
        if not self.held:
            return
        values, counts = np.unique(np.concatenate(self.held), return_counts=True)
        self.held, self.size = [], 0
        values, counts = np.concatenate([self.values, values]), np.concatenate([self.counts, counts])
        order = np.argsort(values, kind="stable")
        values, counts = values[order], counts[order]
        at = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)
        values, counts = values[at], np.add.reduceat(counts, at) if len(at) else counts
        if len(values) > self.most:
            counts = counts - np.partition(counts, len(counts) - self.most)[len(counts) - self.most]
            values, counts = values[counts > 0], counts[counts > 0]
        self.values, self.counts = values, counts


def sets_of(documents: DataFrame, shingle: int) -> DataFrame:
    """_key, text_hash, n (size of the set), node (its name); and, where _key is null, frequent shingles and how often they were seen."""
    schema = pa.schema([("_key", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int64()), ("node", pa.int64())])

    def run(batches):
        seen = _Seen()
        for batch in batches:
            for chunk in W.chunks(batch.column("text"), W.SPACE, True):
                s = Sets(chunk, shingle)
                seen.add(s.values)
                yield pa.RecordBatch.from_arrays([batch.column("_key").slice(chunk.row, chunk.rows), batch.column("text_hash").slice(chunk.row, chunk.rows), pa.array(s.sizes, pa.int64()), pa.array(s.name.view(np.int64))], schema=schema)
        seen.settle()
        often = seen.counts >= LEAST_IN_TASK
        none = pa.nulls(int(often.sum()), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, pa.array(seen.counts[often], pa.int64()), pa.array(seen.values[often].view(np.int64))], schema=schema)

    return documents.mapInArrow(T.light(run), "_key long, text_hash long, n long, node long")


def _prefix_rows(documents: DataFrame, shingle: int, percent: int, frequent: np.ndarray) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(frequent)  # at most MOST_FREQUENT

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for chunk in W.chunks(batch.column("text"), W.SPACE, True):
                s = Sets(chunk, shingle)
                names = s.name.tolist()
                new = np.array([x not in seen for x in names]) if names else np.zeros(0, bool)
                seen.update(names)
                if len(seen) > 500_000:
                    seen.clear()
                take = _prefixes(s, shared.value, percent) & new[s.rows]
                for at in range(0, int(take.sum()), 1 << 16):
                    part = np.flatnonzero(take)[at : at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(s.values[part].view(np.int64)), pa.array(s.name[s.rows[part]].view(np.int64))], ["token", "node"])

    return documents.mapInArrow(T.light(run), "token long, node long")


def _full_sets(documents: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """node, n, tokens (sorted), tasks of the wanted nodes (node, _key, tasks); a repeated row gives its node again."""

    def run(batch: pa.RecordBatch):
        name = batch.column("node").to_numpy(zero_copy_only=False).view(np.uint64)
        for chunk in W.chunks(batch.column("text"), W.SPACE, True):
            s = Sets(chunk, shingle)
            mine = s.name == name[chunk.row : chunk.row + chunk.rows]  # of rows with an equal doc_id, the one that is meant
            tasks = batch.column("tasks").slice(chunk.row, chunk.rows).filter(pa.array(mine))
            yield {"node": s.name[mine], "n": s.sizes[mine], "tokens": T.lists(s.values[mine[s.rows]], s.sizes[mine]), "tasks": tasks}

    # By a merge at every size, so that what is shuffled follows the input.
    joined = documents.join(wanted.hint("merge"), "_key").select("node", "text", "tasks")
    return T.map_batches(joined, run, "node long, n long, tokens array<long>, tasks array<long>")


class _Forest:
    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        p = self.parent.setdefault(x, x)
        while p != self.parent[p]:
            self.parent[p] = self.parent[self.parent[p]]
            p = self.parent[p]
        self.parent[x] = p
        return p

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
        return a != b


def _compare(table: pa.Table, percent: int) -> pa.Table:
    """Edges that connect the classes of members and queries of a task."""
    table = table.combine_chunks()
    role = table.column("role").to_numpy()
    node, kind, n = (table.column(x).to_numpy() for x in ("node", "class", "n"))
    column = table.column("tokens").combine_chunks() if isinstance(table.column("tokens"), pa.ChunkedArray) else table.column("tokens")
    tokens = column.flatten().to_numpy().view(np.uint64)
    ends = np.cumsum(np.asarray(column.value_lengths()))
    members = np.flatnonzero(role != 1)
    owner = np.repeat(np.arange(len(members), dtype=np.int32), n[members])
    pool = np.concatenate([tokens[ends[i] - n[i] : ends[i]] for i in members]) if len(members) else np.zeros(0, np.uint64)
    order = np.argsort(pool, kind="stable")  # so owners of one shingle ascend
    pool, owner = pool[order], owner[order]
    del order
    size, forest, edges = n[members], _Forest(), []
    classes = kind[members]
    one = len(np.unique(classes)) == 1
    queries = np.flatnonzero(role != 0)
    for q in queries[np.argsort(-n[queries], kind="stable")].tolist():
        if one and len(members) and forest.root(int(classes[0])) == forest.root(int(kind[q])):
            continue
        mine = tokens[ends[q] - n[q] : ends[q]]
        a, b = np.searchsorted(pool, mine, "left"), np.searchsorted(pool, mine, "right")
        if np.count_nonzero(b > a) * 100 < percent * n[q]:
            continue  # the bound: its overlap with the union of all members
        hits = owner[np.repeat(a - np.concatenate([[0], np.cumsum(b - a)[:-1]]), b - a) + np.arange(int((b - a).sum()))]
        common = np.bincount(hits, minlength=len(members))
        linked = np.flatnonzero(100 * common >= percent * (size + n[q] - common))
        for m in linked.tolist():
            if forest.join(int(kind[q]), int(classes[m])):
                edges.append((int(node[q]), int(node[members[m]])))
    return pa.table({"a": pa.array([x for x, _ in edges], pa.int64()), "b": pa.array([x for _, x in edges], pa.int64())})


def _edges(tasks: DataFrame, percent: int) -> DataFrame:
    """tasks: task, role (0 member, 1 query, 2 both), node, class, n, tokens."""

    def compare(t: pa.Table) -> pa.Table:
        T.let_go()
        try:
            return _compare(t, percent)
        finally:
            T.trim()

    return tasks.groupBy("task").applyInArrow(compare, "a long, b long")


def linked_nodes(documents: DataFrame, nodes: DataFrame, frequent: np.ndarray, shingle: int, percent: int) -> DataFrame:
    """Edges (a, b) between nodes that connect all that link. nodes: node, n, _key."""
    rows = _prefix_rows(documents, shingle, percent, frequent).repartition("token").dropDuplicates(["token", "node"])
    common = rows.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    rows = T.written(rows.join(common, "token"))
    need = F.lit(1) + F.floor(F.ceil(F.col("n") * percent / 100) * 3 / 100)
    alive = rows.groupBy("node").agg(F.count("*").alias("hits"), F.max(F.struct("df", "token")).alias("top"), F.sum("df").alias("typical"))
    alive = T.written(alive.join(nodes, "node").filter(F.col("hits") >= need).select("node", "n", "_key", F.col("top.token").alias("group"), "typical"))
    groups = alive.groupBy("group").agg(F.count("*").alias("nodes"), F.sum("n").alias("shingles"), F.max(F.struct((F.col("typical") / F.col("n")).alias("by"), "node")).alias("lead"))
    cuts = F.ceil(F.greatest(F.col("nodes") / BLOCK_NODES, F.col("shingles") / BLOCK_SHINGLES)).cast("long")
    groups = groups.filter("nodes > 1").select("group", cuts.alias("cuts"), F.col("lead.node").alias("lead"))
    placed = alive.join(groups, "group", "left").withColumn("block", F.xxhash64("group", F.pmod("node", F.coalesce("cuts", F.lit(1)))))
    placed = T.written(placed.select("node", "n", "_key", "block", "group", F.coalesce("cuts", F.lit(0)).alias("cuts"), "lead"))
    blocks = placed.filter("cuts > 0").select("node", F.col("block").alias("task"))
    leads = placed.filter("cuts > 1").select(F.col("lead").alias("node"), F.col("block").alias("task"))
    tasks = blocks.unionByName(leads).groupBy("node").agg(F.collect_set("task").alias("tasks"))
    sets = T.written(_full_sets(documents, placed.select("node", "_key").join(tasks, "node", "left"), shingle))

    tasks = sets.select(F.explode("tasks").alias("task"), F.lit(2).alias("role"), "node", F.col("node").alias("class"), "n", "tokens")
    first = T.written(_edges(tasks, percent))

    classes = components(first)
    named = placed.select("node", "n", "block").join(classes, "node", "left").select("node", "n", F.coalesce("component", "node").alias("class"), F.col("component").isNull().alias("single"), "block")
    named = named.withColumn("group", F.when(F.col("single"), F.xxhash64(F.lit("single"), "block")).otherwise(F.xxhash64(F.lit("class"), "class")))
    sizes = named.groupBy("group").agg(F.count("*").alias("members"), F.sum("n").alias("shingles"))
    named = T.written(named.join(sizes, "group"))
    mine = rows.join(named.select("node", "group", "members"), "node")
    # a shingle of many nodes meets the matrix in several places, each with a part of its nodes
    places = F.ceil(F.col("df") / SHARED)
    matrix = mine.select("token", "df", F.col("group").alias("of"), F.col("members").alias("of_members")).distinct()
    matrix = matrix.withColumn("place", F.explode(F.sequence(F.lit(0).cast("long"), places - 1))).drop("df")
    mine = mine.withColumn("place", F.pmod(F.xxhash64("node"), places))
    larger = (F.col("of_members") > F.col("members")) | ((F.col("of_members") == F.col("members")) & (F.col("of") > F.col("group")))
    opened = mine.join(matrix, ["token", "place"]).filter(larger).groupBy("node", "of").agg(F.count("*").alias("hits"))
    opened = T.written(opened.join(named.select("node", "n", "class"), "node").filter(F.col("hits") >= need).select("node", "n", "class", "of"))
    asked = opened.groupBy("of").agg(F.count("*").alias("queries"), F.sum("n").alias("asked")).join(sizes.withColumnRenamed("group", "of"), "of")
    asked = asked.select(
        "of", F.ceil(F.greatest(F.col("queries") / QUERIES, F.col("asked") / BLOCK_SHINGLES)).cast("long").alias("sheets"), F.ceil(F.greatest(F.col("members") / (4 * BLOCK_NODES), F.col("shingles") / BLOCK_SHINGLES)).cast("long").alias("cuts")
    )
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    asking = opened.drop("n").join(asked, "of").withColumn("sheet", F.pmod("node", "sheets")).withColumn("cut", each("cuts")).withColumn("role", F.lit(1))
    asked_of = named.withColumnRenamed("group", "of").select("of", "node", "class").join(asked, "of").withColumn("cut", F.pmod("node", "cuts")).withColumn("sheet", each("sheets")).withColumn("role", F.lit(0))
    tasks = asking.select("of", "sheet", "cut", "role", "node", "class").unionByName(asked_of.select("of", "sheet", "cut", "role", "node", "class"))
    tasks = tasks.select(F.xxhash64("of", "sheet", "cut").alias("task"), "role", "node", "class").join(sets.drop("tasks").hint("merge"), "node")
    return first.unionByName(_edges(tasks, percent))


@T.tidy
def similar(documents: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """_key, text_hash, n_shingles, class, component for every document (doc_id, text).

    Documents of one class reach one another by links; component is the least _key among them (doc_id, null last)."""
    docs = documents.select(T.doc_key().alias("_key"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    scanned = T.written(sets_of(docs, shingle))
    docs = docs.drop("text_hash")
    seen = scanned.filter("_key is null").groupBy("node").agg(F.sum("n").alias("seen")).filter(F.col("seen") >= LEAST_SEEN)
    top = seen.orderBy(F.desc("seen"), "node").limit(MOST_FREQUENT).select("node").toPandas()["node"]  # bounded
    frequent = np.sort(top.to_numpy(np.int64).view(np.uint64))
    sets = scanned.filter("_key is not null")
    nodes = T.written(sets.filter("n > 0").groupBy("node", "n").agg(F.min("_key").alias("_key"), F.count("*").alias("copies")))
    classes = components(T.written(linked_nodes(docs, nodes.drop("copies"), frequent, shingle, percent)))
    least = classes.join(nodes, "node").groupBy("component").agg(F.min("_key").alias("least"))
    linked = classes.join(least, "component").select("node", F.col("component").alias("class"), "least")
    first = nodes.join(linked, "node", "left").select("node", F.coalesce("class", "node").alias("class"), F.coalesce("least", "_key").alias("component"), "copies")
    empty = sets.filter("n = 0").select("_key", "text_hash", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("class"), F.col("_key").alias("component"))
    return T.hot_joined(sets.filter("n > 0"), T.written(first), ["node"], "copies").select("_key", "text_hash", F.col("n").alias("n_shingles"), "class", "component").unionByName(empty)


def _id(key: str) -> Column:
    return F.when(F.col(key) != T.LAST_ID, F.col(key))


def op1_ngram_join(spark, sf_dir: str) -> DataFrame:
    found = similar(T.read(spark, sf_dir, "documents"))
    return found.select(_id("_key").alias("doc_id"), "n_shingles", _id("component").alias("component_id"))


ORACLE = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
r AS (SELECT doc_id AS node, doc_id AS dest FROM d UNION SELECT r.node, l.y FROM r JOIN l ON l.x = r.dest),
c AS (SELECT node, min(dest) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id FROM d JOIN c ON c.node = d.doc_id LEFT JOIN n USING (doc_id)
"""
