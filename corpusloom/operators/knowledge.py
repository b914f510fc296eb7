"""A typed knowledge graph as tables, and the dialogue rows compiled from it.

nodes: id, node_type, labels map, metadata map; relations: id, subject_type, object_type; facts: subject_id,
relation_id, object_id; templates: id, category, language, relation_id (nullable), messages.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranges

FACT = ["subject_id", "relation_id", "object_id"]
# The roles of templates.
TEMPLATE_ROLES = ("user", "assistant")
# End of fixed values.


def unique(rows: DataFrame, key: list[str]) -> DataFrame:
    """Equal rows once; a key with different rows raises."""
    plain = [F.array_sort(F.map_entries(c)) if kind.startswith("map") else F.col(c) for c, kind in rows.dtypes]
    marked = rows.withColumn("_mark", F.sha2(F.to_json(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(plain)]), {"ignoreNullFields": "false"}), 256))
    once = marked.groupBy(*key).agg(F.first(F.struct(*rows.columns)).alias("_row"), F.min("_mark").alias("_low"), F.max("_mark").alias("_high"))
    conflict = F.raise_error(F.concat(F.lit("conflict: "), F.concat_ws("/", *key))).cast("boolean")
    return once.filter(F.when(F.col("_low") != F.col("_high"), conflict).otherwise(F.lit(True))).select("_row.*")


def typed(facts: DataFrame, relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Facts with problem: null, or what is wrong with their ends, their relation or the types."""
    n = nodes.select("id", "node_type")
    s, o = n.toDF("subject_id", "s_type"), n.toDF("object_id", "o_type")
    out = facts.join(relations.withColumnRenamed("id", "relation_id"), "relation_id", "left").join(s, "subject_id", "left").join(o, "object_id", "left")
    problem = (
        F.when(F.col("subject_type").isNull(), "relation")
        .when(F.col("s_type").isNull(), "subject")
        .when(F.col("o_type").isNull(), "object")
        .when(F.col("s_type") != F.col("subject_type"), "subject_type")
        .when(F.col("o_type") != F.col("object_type"), "object_type")
    )
    return out.select(*FACT, problem.alias("problem"))


def valid_facts(facts: DataFrame, relations: DataFrame, nodes: DataFrame) -> DataFrame:
    return typed(facts, relations, nodes).filter("problem is null").drop("problem")


def matching(facts: DataFrame, subject: str | None = None, relation: str | None = None, obj: str | None = None) -> DataFrame:
    for column, value in zip(FACT, (subject, relation, obj), strict=True):
        if value is not None:
            facts = facts.filter(F.col(column) == value)
    return facts


def of_type(nodes: DataFrame, node_type: str | None = None) -> DataFrame:
    """All nodes, or those of a type."""
    return nodes if node_type is None else nodes.filter(F.col("node_type") == node_type)


def looked_up(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The rows of the keys asked for; a key without a row raises."""
    marked = keys.join(rows.withColumn("_there", F.lit(True)), on, "left")
    lost = F.raise_error(F.concat(F.lit("not there: "), F.concat_ws("/", *on))).cast("boolean")
    return marked.filter(F.when(F.col("_there").isNull(), lost).otherwise(F.lit(True))).drop("_there")


def members(keys: DataFrame, rows: DataFrame, on: list[str]) -> DataFrame:
    """The keys with whether a row has them."""
    return keys.join(rows.select(*on).distinct().withColumn("_there", F.lit(True)), on, "left").withColumn("there", F.col("_there").isNotNull()).drop("_there")


def missing(facts: DataFrame, relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Subjects of the right type that lack a relation's fact."""
    every = relations.join(nodes.select(F.col("id").alias("subject_id"), "node_type"), F.col("subject_type") == F.col("node_type")).select("subject_id", F.col("id").alias("relation_id"))
    return every.join(facts.select("subject_id", "relation_id"), ["subject_id", "relation_id"], "left_anti")


def label(labels: Column, language: Column) -> Column:
    """The label in a language; a missing one raises."""
    found = F.try_element_at(labels, language)
    return F.when(found.isNull(), F.raise_error(F.concat(F.lit("no label in "), language)).cast("string")).otherwise(found)


def with_labels(facts: DataFrame, nodes: DataFrame, language: Column) -> DataFrame:
    s = nodes.select(F.col("id").alias("subject_id"), F.col("labels").alias("s_labels"), F.col("metadata").alias("s_meta"))
    o = nodes.select(F.col("id").alias("object_id"), F.col("labels").alias("o_labels"), F.col("metadata").alias("o_meta"))
    return facts.join(s, "subject_id").join(o, "object_id").withColumn("subject", label(F.col("s_labels"), language)).withColumn("object", label(F.col("o_labels"), language))


def substituted(text: Column, values: Column) -> Column:
    """A template's {names} replaced from a map; one that is left raises."""
    done = F.aggregate(F.map_entries(values), text, lambda t, e: F.replace(t, F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"]))
    return F.when(done.rlike("\\{[A-Za-z_]+\\}"), F.raise_error(F.concat(F.lit("no value for "), F.regexp_extract(done, "\\{[A-Za-z_]+\\}", 0))).cast("string")).otherwise(done)


def rendered(messages: Column, values: Column) -> Column:
    return F.transform(messages, lambda m: F.struct(m["role"].alias("role"), substituted(m["content"], values).alias("content")))


def composed(*providers: Column) -> Column:
    """Maps put together; a key that two have raises, as map_concat does."""
    return F.map_concat(*providers)


#: Languages that a template without one is rendered in.
LANGUAGES = ("en", "pt")


def in_languages(templates: DataFrame, languages=LANGUAGES) -> DataFrame:
    """Templates with a row for each language they are for: a null language is every one."""
    own = F.when(F.col("language").isNull(), F.array(*[F.lit(x) for x in languages])).otherwise(F.array("language"))
    return templates.withColumn("language", F.explode(own))


def uppercase_values(rows: DataFrame) -> Column:
    """The labels of a fact's ends in upper case, as values for templates. rows: subject, object."""
    return F.create_map(F.lit("subject_upper"), F.upper("subject"), F.lit("object_upper"), F.upper("object"))


def template_problems(templates: DataFrame) -> DataFrame:
    """id, problems of each template: what is wrong with its fields, its messages and their order."""
    m, n = F.col("messages"), F.size("messages")
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    roles = F.transform(m, lambda x: x["role"])
    pairs = F.zip_with(F.slice(roles, F.lit(1), F.greatest(F.lit(0), n - 1)), F.slice(roles, F.lit(2), F.greatest(F.lit(0), n - 1)), lambda a, b: a == b)
    one = lambda bad, name: F.when(F.coalesce(bad, F.lit(True)), F.lit(name))
    fields = [one(blank(F.col("id")), "id"), one(blank(F.col("category")), "category"), one(m.isNull() | (n < 1), "messages")]
    each = [one(F.exists(m, lambda x: ~F.coalesce(x["role"].isin(*TEMPLATE_ROLES), F.lit(False))), "role"), one(F.exists(m, lambda x: blank(x["content"])), "content")]
    order = [one(F.get(roles, F.lit(0)) != "user", "first"), one(F.try_element_at(roles, F.lit(-1)) != "assistant", "last"), one(F.exists(pairs, lambda x: x), "alternation")]
    found = F.filter(F.array(*fields, *[F.when(m.isNotNull() & (n > 0), x) for x in each + order]), lambda x: x.isNotNull())
    return templates.select("id", found.alias("problems"))


def compile_rows(facts: DataFrame, nodes: DataFrame, templates: DataFrame, values: Callable[[DataFrame], Column] | None = None) -> DataFrame:
    """id, category, language, stage, messages: each fact by each template of its relation; ids count them in the order of a hash."""
    t = in_languages(templates.filter("relation_id is not null")).select("relation_id", F.col("id").alias("template_id"), "category", "language", F.col("messages").alias("template"))
    # templates are authored by hand; Catalyst sizes the join
    joined = with_labels(facts.join(t, "relation_id"), nodes, F.col("language"))
    base = F.create_map(F.lit("subject"), F.col("subject"), F.lit("object"), F.col("object"))
    both = composed(base, values(joined)) if values else base
    order = F.md5(F.concat_ws("|", "subject_id", "object_id", "template_id"))
    placed = ranges.numbered(ranges.hashed(joined.withColumn("_values", both), "_order", order), ["_order", "subject_id", "object_id", "template_id"], ("category", "language", "relation_id"), "_k")
    return placed.select(
        F.format_string("%s_%s_%s_%05d", "category", "language", "relation_id", "_k").alias("id"), "category", "language", F.lit("stage0").alias("stage"), rendered(F.col("template"), F.col("_values")).alias("messages")
    )


def static_rows(templates: DataFrame) -> DataFrame:
    """Rows of templates that ask for no relation."""
    t = templates.filter("relation_id is null")
    k = F.row_number().over(Window.partitionBy("category", "language").orderBy("id"))
    return t.select(F.format_string("%s_%s_static_%05d", "category", "language", k).alias("id"), "category", "language", F.lit("stage0").alias("stage"), "messages")


def uncertainty_rows(facts: DataFrame, relations: DataFrame, nodes: DataFrame, templates: DataFrame) -> DataFrame:
    """A known fact as context and a question about a subject that lacks one: for every missing fact, the first fact of its relation."""
    first = facts.groupBy("relation_id").agg(F.min(F.struct("subject_id", "object_id")).alias("f")).select("relation_id", F.col("f.subject_id").alias("subject_id"), F.col("f.object_id").alias("object_id"))
    asked = missing(facts, relations, nodes).withColumnRenamed("subject_id", "target_id")
    t = templates.filter("category = 'uncertainty'").select(F.col("id").alias("template_id"), "category", "language", F.col("messages").alias("template"), F.col("relation_id").alias("r"))
    scen = asked.join(first, "relation_id").filter("target_id <> subject_id").join(t, F.col("r") == F.col("relation_id"))
    scen = with_labels(scen, nodes, F.col("language"))
    target = nodes.select(F.col("id").alias("target_id"), F.col("labels").alias("t_labels"))
    scen = scen.join(target, "target_id").withColumn("target", label(F.col("t_labels"), F.col("language")))
    values = F.create_map(F.lit("context_subject"), F.col("subject"), F.lit("context_object"), F.col("object"), F.lit("target_subject"), F.col("target"))
    k = F.row_number().over(Window.partitionBy("category", "language", "relation_id", "target_id").orderBy("template_id"))
    name = F.format_string("%s_%s_%s_%s_%03d", "category", "language", "subject_id", "target_id", k)
    return scen.select(name.alias("id"), "category", "language", F.lit("stage0").alias("stage"), rendered(F.col("template"), values).alias("messages"))


def scenario_problems(scenarios: DataFrame, facts: DataFrame) -> DataFrame:
    """What is wrong with scenarios that ask about an unknown fact: the first of the rules broken, or null.

    scenarios: id, relation_id, subject_id, object_id (the context's fact), target_relation_id, target_id."""
    known = facts.select(*FACT).distinct()
    out = scenarios.join(known.withColumn("_known", F.lit(True)), FACT, "left")
    has = known.select(F.col("subject_id").alias("target_id"), F.col("relation_id").alias("target_relation_id")).distinct().withColumn("_has", F.lit(True))
    out = out.join(has, ["target_id", "target_relation_id"], "left")
    problem = (
        F.when(F.col("_known").isNull(), "context_fact")
        .when(F.col("relation_id") != F.col("target_relation_id"), "relation")
        .when(F.col("subject_id") == F.col("target_id"), "same_subject")
        .when(F.col("_has"), "target_known")
    )
    return out.select(*scenarios.columns, problem.alias("problem"))


def wrong_objects(facts: DataFrame, seed: int = 0) -> DataFrame:
    """For each fact another object of its relation, picked by a seeded hash; facts without one are left out.

    The objects of a relation are numbered, and the hash picks among the numbers that are not the fact's own, so facts
    and objects are never paired."""
    objects = facts.select("relation_id", "object_id").distinct()
    placed = ranges.numbered(ranges.hashed(objects, "_name", F.md5(F.concat_ws("|", *["relation_id", "object_id"]))), ["_name", "object_id"], ("relation_id",), "_own").drop("_name")
    count = placed.groupBy("relation_id").agg(F.count("*").alias("_n"))
    own = facts.join(placed, ["relation_id", "object_id"]).join(F.broadcast(count), "relation_id").filter("_n > 1")  # a row for each relation
    pick = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *FACT)), 1, 8), 16, 10).cast("long") % (F.col("_n") - 1) + 1
    own = own.withColumn("_pick", F.when(pick >= F.col("_own"), pick + 1).otherwise(pick))
    other = placed.select("relation_id", F.col("object_id").alias("wrong_id"), F.col("_own").alias("_pick"))
    return own.join(other, ["relation_id", "_pick"]).select(*FACT, "wrong_id")


def grammar_index(forms: DataFrame) -> DataFrame:
    """form, features, value with the features as one sorted text; a repeated key raises."""
    spelled = F.array_join(F.transform(F.array_sort(F.map_entries("features")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|")
    return unique(forms.select("form", spelled.alias("features"), "value"), ["form", "features"])


def node_features(metadata: Column, spec: dict[str, str], defaults: dict[str, str]) -> Column:
    """Features of a node: from its metadata, overridden by the defaults; sorted, as one text."""
    from_meta = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("key"), F.try_element_at(metadata, F.lit(v)).alias("value")) for k, v in spec.items() if k not in defaults]), lambda e: e["value"].isNotNull()))
    fixed = F.create_map(*[F.lit(x) for kv in defaults.items() for x in kv])
    return F.array_join(F.transform(F.array_sort(F.map_entries(F.map_concat(from_meta, fixed))), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|")


def grammar_values(nodes: DataFrame, index: DataFrame, specs: DataFrame, spec: dict[str, str], defaults: dict[str, str], prefix: str) -> DataFrame:
    """id, forms: map from {prefix}_{key} to the surface form that a node's features ask for."""
    wanted = nodes.select("id", node_features(F.col("metadata"), spec, defaults).alias("features")).crossJoin(specs)  # specs: a hand-written list of keys
    found = wanted.join(index, ["form", "features"])
    return found.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat(F.lit(prefix + "_"), "key"), "value")))).alias("forms"))


def relation_problems(pairs: DataFrame, templates: DataFrame) -> DataFrame:
    """relation, language, problem: languages with pairs and no template, and templates that do not name the subject."""
    lost = pairs.select("relation", "language").distinct().join(templates.select("relation", "language").distinct(), ["relation", "language"], "left_anti")
    unnamed = templates.filter(~F.contains("template", F.lit("{subject}"))).select("relation", "language", F.lit("no_subject").alias("problem"))
    return lost.withColumn("problem", F.lit("no_template")).unionByName(unnamed)


def relation_table(pairs: DataFrame, templates: DataFrame) -> DataFrame:
    """Questions of a relation table: each subject by each template of its relation and language; the first letter upper-cased."""
    joined = pairs.join(F.broadcast(templates), ["relation", "language"])  # templates are written by hand
    order = F.md5(F.concat_ws("|", "subject", "template"))
    placed = ranges.numbered(ranges.hashed(joined, "_order", order), ["_order", "subject", "template"], ("relation", "language"), "_k")
    q = F.replace(F.col("template"), F.lit("{subject}"), F.col("subject"))
    return placed.select(
        F.format_string("%s_%s_%05d", "relation", "language", "_k").alias("id"), F.lit("knowledge_completion").alias("category"), "language", F.lit("stage0").alias("stage"),
        F.concat(F.upper(F.left(q, F.lit(1))), F.substring(q, 2, 1 << 30)).alias("question"), "answer",
    )


class KnowledgeBase:
    """Nodes, relations and facts of one graph; facts that break their relation's types raise when they are read."""

    def __init__(self, nodes: DataFrame, relations: DataFrame, facts: DataFrame):
        self.nodes, self.relations = unique(nodes, ["id"]), unique(relations, ["id"])
        wrong = F.raise_error(F.concat(F.lit("fact: "), F.concat_ws("/", *FACT), F.lit(" "), F.col("problem"))).cast("boolean")
        checked = typed(unique(facts.select(*FACT), FACT), relations, nodes)
        self.facts = checked.filter(F.when(F.col("problem").isNotNull(), wrong).otherwise(F.lit(True))).drop("problem")


@dataclass(frozen=True)
class RelationBuild:
    """Rows of a relation's facts by the templates of a category; ``values`` adds values for the templates."""

    id: str
    relation: str
    category: str
    values: Callable[[DataFrame], Column] | None = None

    def rows(self, kb: KnowledgeBase, templates: DataFrame) -> DataFrame:
        mine = templates.filter((F.col("category") == self.category) & (F.col("relation_id") == self.relation))
        return compile_rows(matching(kb.facts, relation=self.relation), kb.nodes, mine, self.values)


@dataclass(frozen=True)
class ScenarioBuild:
    """Rows that ask about facts which the graph lacks."""

    id: str
    relation: str

    def rows(self, kb: KnowledgeBase, templates: DataFrame) -> DataFrame:
        mine = templates.filter(F.col("relation_id") == self.relation)
        return uncertainty_rows(matching(kb.facts, relation=self.relation), kb.relations.filter(F.col("id") == self.relation), kb.nodes, mine)


@dataclass(frozen=True)
class StaticBuild:
    id: str

    def rows(self, kb: KnowledgeBase, templates: DataFrame) -> DataFrame:
        return static_rows(templates)


def built(builds, kb: KnowledgeBase, templates: DataFrame) -> DataFrame:
    """build and the rows of all builds; two builds of one id raise."""
    names = [b.id for b in builds]
    if len(set(names)) < len(names):
        raise ValueError(f"builds of equal id: {names}")
    out = None
    for b in builds:
        one = b.rows(kb, templates).withColumn("build", F.lit(b.id))
        out = one if out is None else out.unionByName(one)
    return out
