"""A knowledge graph over the star tables, and the dialogue rows compiled from it.

Nodes are regions, nations, suppliers and parts; relations tell a nation's region, a supplier's nation and the first
supplier of a part that was sold in small numbers.  Labels are names; the Portuguese gender, which the tables lack, follows the key.
Templates and grammar are written by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import knowledge as K
from .base import literal, query, table

TEMPLATES = [
    ("kc.region.en.1", "knowledge_completion", "en", "region_of", [("user", "Where is {subject}?"), ("assistant", "In {object}.")]),
    ("kc.region.en.2", "knowledge_completion", "en", "region_of", [("user", "Name the region of {subject}."), ("assistant", "{object}")]),
    ("kc.region.pt.1", "knowledge_completion", "pt", "region_of", [("user", "Qual é a região {subject_of}{subject}?"), ("assistant", "{object}.")]),
    ("kc.home.1", "knowledge_completion", None, "home", [("user", "{subject}?"), ("assistant", "{object}.")]),
    ("if.home.en.1", "instruction_following", "en", "home", [("user", "In capital letters: where is {subject}?"), ("assistant", "{object_upper}")]),
    ("un.sold.en.1", "uncertainty", "en", "sold_by", [("user", "{context_object} sells {context_subject}. And {target_subject}?"), ("assistant", "I do not know.")]),
    ("tt.en.1", "turn_taking", "en", None, [("user", "Hello."), ("assistant", "Hello!")]),
    ("tt.pt.1", "turn_taking", "pt", None, [("user", "Olá."), ("assistant", "Olá!")]),
]
#: Templates with faults: blank id, no messages, a system turn, two users, a blank text.
FAULTY = [
    (" ", "turn_taking", "en", None, [("user", "Hi."), ("assistant", "Hi.")]),
    ("bad.2", "", "en", None, []),
    ("bad.3", "turn_taking", "en", None, [("system", "Hi."), ("assistant", "Hi.")]),
    ("bad.4", "turn_taking", "en", None, [("user", "Hi."), ("user", " ")]),
]
FAULTS = [(" ", "id"), ("bad.2", "category,messages"), ("bad.3", "role,first"), ("bad.4", "content,last,alternation")]
FORMS = [("article.of", {"Gender": "Masc", "Number": "Sing"}, "do "), ("article.of", {"Gender": "Fem", "Number": "Sing"}, "da "), ("article", {"Gender": "Masc", "Number": "Sing"}, "o "), ("article", {"Gender": "Fem", "Number": "Sing"}, "a ")]
SPECS = [("of", "article.of"), ("the", "article")]
SPEC, DEFAULTS = {"Gender": "pt_gender"}, {"Number": "Sing"}
RELATIONS = [("region_of", "nation", "region"), ("home", "supplier", "nation"), ("sold_by", "part", "supplier")]
BUILDS = (
    K.RelationBuild("regions", "region_of", "knowledge_completion", lambda rows: F.col("forms")),
    K.RelationBuild("homes", "home", "knowledge_completion", lambda rows: F.col("forms")),
    K.RelationBuild("homes_upper", "home", "instruction_following", K.uppercase_values),
    K.ScenarioBuild("unsold", "sold_by"),
    K.StaticBuild("static"),
)

_MAP = "map<string,string>"


def nodes(spark, sf_dir):
    """id, node_type, labels, metadata."""
    of = lambda name, kind, key, label: table(spark, sf_dir, name).select(F.concat(F.lit(f"{kind}."), key).alias("id"), F.lit(kind).alias("node_type"), F.col(label).alias("name"), F.col(key).alias("key"))
    every = of("region", "region", "r_regionkey", "r_name").unionByName(of("nation", "nation", "n_nationkey", "n_name"))
    every = every.unionByName(of("supplier", "supplier", "s_suppkey", "s_name")).unionByName(of("part", "part", "p_partkey", "p_name"))
    gender = F.when(F.col("key") % 2 == 0, "Masc").otherwise("Fem")
    return every.select("id", "node_type", F.create_map(F.lit("en"), "name", F.lit("pt"), "name").alias("labels"), F.create_map(F.lit("pt_gender"), gender).alias("metadata"))


def relations(spark):
    return spark.createDataFrame(RELATIONS, "id string, subject_type string, object_type string")


def facts(spark, sf_dir):
    """subject_id, relation_id, object_id."""
    named = lambda kind, key: F.concat(F.lit(f"{kind}."), key)
    of_nations = table(spark, sf_dir, "nation").select(named("nation", "n_nationkey").alias("subject_id"), F.lit("region_of").alias("relation_id"), named("region", "n_regionkey").alias("object_id"))
    homes = table(spark, sf_dir, "supplier").select(named("supplier", "s_suppkey").alias("subject_id"), F.lit("home").alias("relation_id"), named("nation", "s_nationkey").alias("object_id"))
    sold = table(spark, sf_dir, "lineitem").filter("l_quantity <= 2").groupBy("l_partkey").agg(F.min("l_suppkey").alias("s"))
    return of_nations.unionByName(homes).unionByName(sold.select(named("part", "l_partkey").alias("subject_id"), F.lit("sold_by").alias("relation_id"), named("supplier", "s").alias("object_id")))


def wrong(spark, sf_dir):
    """Facts with faults, made of the right ones: turned round, of an unknown relation, of an unknown end."""
    right = facts(spark, sf_dir)
    turned = right.filter("relation_id = 'home'").select(F.col("object_id").alias("subject_id"), "relation_id", F.col("subject_id").alias("object_id")).distinct()
    unknown = right.filter("relation_id = 'region_of'").withColumn("relation_id", F.lit("owner"))
    lost = right.filter("relation_id = 'home'").withColumn("subject_id", F.concat("subject_id", F.lit("x")))
    gone = right.filter("relation_id = 'home'").withColumn("object_id", F.concat("object_id", F.lit("x")))
    return turned.unionByName(unknown).unionByName(lost).unionByName(gone)


def templates(spark, rows=TEMPLATES):
    return spark.createDataFrame(rows, "id string, category string, language string, relation_id string, messages array<struct<role:string,content:string>>")


def _forms(spark):
    return spark.createDataFrame(FORMS, f"form string, features {_MAP}, value string")


def _specs(spark):
    return spark.createDataFrame(SPECS, "key string, form string")


def _grammar(spark, sf_dir):
    return K.grammar_values(nodes(spark, sf_dir), K.grammar_index(_forms(spark)), _specs(spark), SPEC, DEFAULTS, "subject")


def base(spark, sf_dir):
    return K.KnowledgeBase(nodes(spark, sf_dir), relations(spark), facts(spark, sf_dir))


def _values(rows):
    return ", ".join("(" + ", ".join("NULL" if x is None else literal(str(x)) for x in r) + ")" for r in rows)


_GENDER = "CASE WHEN key % 2 = 0 THEN 'Masc' ELSE 'Fem' END"
_NODES = f"""n AS (SELECT node_type || '.' || key AS id, node_type, name, {_GENDER} AS gender FROM (
 SELECT 'region' AS node_type, CAST(r_regionkey AS BIGINT) AS key, r_name AS name FROM region UNION ALL SELECT 'nation', n_nationkey, n_name FROM nation
 UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier UNION ALL SELECT 'part', p_partkey, p_name FROM part))"""
_REL = f"r(id, subject_type, object_type) AS (VALUES {_values(RELATIONS)})"
_FACTS = """f AS (SELECT 'nation.' || n_nationkey AS subject_id, 'region_of' AS relation_id, 'region.' || n_regionkey AS object_id FROM nation
 UNION ALL SELECT 'supplier.' || s_suppkey, 'home', 'nation.' || s_nationkey FROM supplier
 UNION ALL SELECT 'part.' || l_partkey, 'sold_by', 'supplier.' || min(l_suppkey) FROM lineitem WHERE l_quantity <= 2 GROUP BY l_partkey)"""
_WRONG = """w AS (SELECT DISTINCT object_id AS subject_id, relation_id, subject_id AS object_id FROM f WHERE relation_id = 'home' UNION ALL SELECT subject_id, 'owner', object_id FROM f WHERE relation_id = 'region_of'
 UNION ALL SELECT subject_id || 'x', relation_id, object_id FROM f WHERE relation_id = 'home' UNION ALL SELECT subject_id, relation_id, object_id || 'x' FROM f WHERE relation_id = 'home')"""
_T = f"t0(id, category, language, relation_id, ask, reply) AS (VALUES {_values([(a, b, c, d, m[0][1], m[1][1]) for a, b, c, d, m in TEMPLATES])}), t AS (SELECT id, category, l AS language, relation_id, ask, reply FROM t0 JOIN (VALUES ('en'), ('pt')) v(l) ON language = l OR language IS NULL)"
_TYPED = f"""WITH {_NODES}, {_REL}, {_FACTS}, {_WRONG}, x AS (SELECT a.*, CASE WHEN r.id IS NULL THEN 'relation' WHEN s.id IS NULL THEN 'subject' WHEN o.id IS NULL THEN 'object' WHEN s.node_type <> subject_type THEN 'subject_type' WHEN o.node_type <> object_type THEN 'object_type' END AS problem
 FROM (SELECT * FROM f UNION ALL SELECT * FROM w) a LEFT JOIN r ON r.id = relation_id LEFT JOIN n s ON s.id = subject_id LEFT JOIN n o ON o.id = object_id)"""


def _all(spark, sf_dir):
    return facts(spark, sf_dir).unionByName(wrong(spark, sf_dir))


@query("kb_valid_facts", f"{_TYPED} SELECT subject_id, relation_id, object_id FROM x WHERE problem IS NULL")
def kb_valid_facts(spark, sf_dir):
    return K.valid_facts(_all(spark, sf_dir), relations(spark), nodes(spark, sf_dir))


@query("kb_invalid_facts", f"{_TYPED} SELECT * FROM x WHERE problem IS NOT NULL")
def kb_invalid_facts(spark, sf_dir):
    return K.typed(_all(spark, sf_dir), relations(spark), nodes(spark, sf_dir)).filter("problem is not null")


@query("kb_objects", f"WITH {_NODES}, {_FACTS} SELECT n.id, node_type FROM f JOIN n ON n.id = object_id WHERE subject_id = 'supplier.3' AND relation_id = 'home'")
def kb_objects(spark, sf_dir):
    found = K.matching(facts(spark, sf_dir), subject="supplier.3", relation="home")
    return found.join(nodes(spark, sf_dir), F.col("id") == F.col("object_id")).select("id", "node_type")


@query("kb_subjects", f"WITH {_NODES}, {_FACTS} SELECT n.id, node_type FROM f JOIN n ON n.id = subject_id WHERE object_id = 'nation.2' AND relation_id = 'home'")
def kb_subjects(spark, sf_dir):
    found = K.matching(facts(spark, sf_dir), relation="home", obj="nation.2")
    return found.join(nodes(spark, sf_dir), F.col("id") == F.col("subject_id")).select("id", "node_type")


@query("kb_nodes_of_type", f"WITH {_NODES} SELECT id, name, gender FROM n WHERE node_type = 'supplier'")
def kb_nodes_of_type(spark, sf_dir):
    found = K.of_type(nodes(spark, sf_dir), "supplier")
    return found.select("id", F.element_at("labels", "en").alias("name"), F.element_at("metadata", "pt_gender").alias("gender"))


@query("kb_lookup", f"WITH {_NODES}, {_FACTS} SELECT DISTINCT id, node_type, name FROM n JOIN f ON object_id = id WHERE relation_id = 'sold_by'")
def kb_lookup(spark, sf_dir):
    """The nodes that facts of a relation end in; one that is not there would raise."""
    keys = K.matching(facts(spark, sf_dir), relation="sold_by").select(F.col("object_id").alias("id")).distinct()
    return K.looked_up(nodes(spark, sf_dir), keys, ["id"]).select("id", "node_type", F.element_at("labels", "en").alias("name"))


@query("kb_membership", f"WITH {_NODES}, {_FACTS}, {_WRONG}, k AS (SELECT DISTINCT subject_id AS id FROM w) SELECT id, id IN (SELECT id FROM n) AS there FROM k")
def kb_membership(spark, sf_dir):
    keys = wrong(spark, sf_dir).select(F.col("subject_id").alias("id")).distinct()
    return K.members(keys, nodes(spark, sf_dir), ["id"])


@query("kb_fact_membership", f"WITH {_FACTS}, {_WRONG}, a AS (SELECT * FROM f UNION ALL SELECT * FROM w) SELECT subject_id, relation_id, object_id, (subject_id, relation_id, object_id) IN (SELECT (subject_id, relation_id, object_id) FROM f) AS there FROM a")
def kb_fact_membership(spark, sf_dir):
    return K.members(_all(spark, sf_dir), facts(spark, sf_dir), K.FACT)


@query("kb_missing", f"WITH {_NODES}, {_REL}, {_FACTS} SELECT n.id AS subject_id, r.id AS relation_id FROM r JOIN n ON n.node_type = subject_type WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.subject_id = n.id AND f.relation_id = r.id)")
def kb_missing(spark, sf_dir):
    return K.missing(facts(spark, sf_dir), relations(spark), nodes(spark, sf_dir))


@query("kb_upsert", f"WITH {_FACTS} SELECT DISTINCT * FROM (SELECT * FROM f UNION ALL SELECT * FROM f)")
def kb_upsert(spark, sf_dir):
    return K.unique(facts(spark, sf_dir).unionByName(facts(spark, sf_dir)), K.FACT)


@query("kb_counts", f"WITH {_NODES}, {_REL}, {_FACTS} SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM r) AS relations, (SELECT count(*) FROM f) AS facts, (SELECT count(DISTINCT relation_id) FROM f) AS used_relations")
def kb_counts(spark, sf_dir):
    kb = base(spark, sf_dir)
    one = lambda df, name: df.agg(F.count("*").alias(name))
    out = one(kb.nodes, "nodes").crossJoin(one(kb.relations, "relations")).crossJoin(one(kb.facts, "facts"))  # single rows
    return out.crossJoin(kb.facts.agg(F.countDistinct("relation_id").alias("used_relations")))


_SAID = "replace(replace(replace(replace({0}, '{{subject_of}}', art), '{{subject}}', sl), '{{object_upper}}', upper(ol)), '{{object}}', ol)"
_COMPILED = f"""j AS (SELECT category, language, t.relation_id, subject_id, object_id, t.id AS tid, ask, reply, s.name AS sl, o.name AS ol, CASE s.gender WHEN 'Masc' THEN 'do ' ELSE 'da ' END AS art
 FROM f JOIN t USING (relation_id) JOIN n s ON s.id = subject_id JOIN n o ON o.id = object_id WHERE t.category <> 'uncertainty'),
 c AS (SELECT category || '_' || language || '_' || relation_id || '_' || lpad(CAST(row_number() OVER (PARTITION BY category, language, relation_id ORDER BY md5(subject_id || '|' || object_id || '|' || tid), subject_id, object_id, tid) AS VARCHAR), 5, '0') AS id, category, language, relation_id, 'stage0' AS stage,
 {_SAID.format('ask')} AS question, {_SAID.format('reply')} AS answer FROM j)"""


def _with_forms(spark, sf_dir):
    """The graph whose facts carry the grammar forms of their subjects."""
    kb = base(spark, sf_dir)
    forms = _grammar(spark, sf_dir).select(F.col("id").alias("subject_id"), "forms")
    kb.facts = kb.facts.join(forms, "subject_id")
    return kb


@query("compile_fact_rows", f"WITH {_NODES}, {_FACTS}, {_T}, {_COMPILED} SELECT id, category, language, stage, question, answer FROM c WHERE category = 'knowledge_completion'")
def compile_fact_rows(spark, sf_dir):
    kb, t = _with_forms(spark, sf_dir), templates(spark)
    return _flat(K.built(BUILDS[:2], kb, t))


@query("compile_uppercase", f"WITH {_NODES}, {_FACTS}, {_T}, {_COMPILED} SELECT id, category, language, stage, question, answer FROM c WHERE category = 'instruction_following'")
def compile_uppercase(spark, sf_dir):
    return _flat(BUILDS[2].rows(base(spark, sf_dir), templates(spark)))


def _flat(rows):
    return rows.select("id", "category", "language", "stage", F.get("messages", F.lit(0))["content"].alias("question"), F.get("messages", F.lit(1))["content"].alias("answer"))


@query("compile_static_rows", f"WITH {_T} SELECT category || '_' || language || '_static_' || lpad(CAST(row_number() OVER (PARTITION BY category, language ORDER BY id) AS VARCHAR), 5, '0') AS id, category, language, 'stage0' AS stage, ask AS question, reply AS answer FROM t WHERE relation_id IS NULL")
def compile_static_rows(spark, sf_dir):
    return _flat(K.static_rows(templates(spark)))


_SCENARIO = """miss AS (SELECT n.id AS target_id, r.id AS relation_id FROM r JOIN n ON n.node_type = subject_type WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.subject_id = n.id AND f.relation_id = r.id)),
 first AS (SELECT relation_id, min({'s': subject_id, 'o': object_id}) AS x FROM f GROUP BY relation_id),
 sc AS (SELECT category || '_' || language || '_' || x.s || '_' || target_id || '_' || lpad(CAST(row_number() OVER (PARTITION BY category, language, relation_id, target_id ORDER BY t.id) AS VARCHAR), 3, '0') AS id, category, language, 'stage0' AS stage,
 replace(replace(replace(ask, '{context_subject}', s.name), '{context_object}', o.name), '{target_subject}', g.name) AS question, reply AS answer
 FROM miss JOIN first USING (relation_id) JOIN t USING (relation_id) JOIN n s ON s.id = x.s JOIN n o ON o.id = x.o JOIN n g ON g.id = target_id WHERE t.category = 'uncertainty' AND target_id <> x.s)"""


@query("compile_scenario", f"WITH {_NODES}, {_REL}, {_FACTS}, {_T}, {_SCENARIO} SELECT * FROM sc")
def compile_scenario(spark, sf_dir):
    return _flat(BUILDS[3].rows(base(spark, sf_dir), templates(spark)))


@query(
    "scenario_problems",
    f"""WITH {_FACTS}, c AS (SELECT subject_id, object_id FROM f WHERE relation_id = 'home'), s AS (
 SELECT 'ok.' || subject_id AS id, 'home' AS relation_id, subject_id, object_id, 'home' AS target_relation_id, subject_id || 'x' AS target_id FROM c UNION ALL
 SELECT 'fact.' || subject_id, 'home', subject_id, object_id || 'x', 'home', subject_id || 'x' FROM c UNION ALL SELECT 'rel.' || subject_id, 'home', subject_id, object_id, 'sold_by', subject_id || 'x' FROM c UNION ALL
 SELECT 'self.' || subject_id, 'home', subject_id, object_id, 'home', subject_id FROM c UNION ALL SELECT 'known.' || subject_id, 'home', subject_id, object_id, 'home', 'supplier.0' FROM c WHERE subject_id <> 'supplier.0')
 SELECT id, CASE split_part(id, '.', 1) WHEN 'fact' THEN 'context_fact' WHEN 'rel' THEN 'relation' WHEN 'self' THEN 'same_subject' WHEN 'known' THEN 'target_known' END AS problem FROM s""",
)
def scenario_problems(spark, sf_dir):
    """Scenarios of every kind of fault, made of the suppliers' facts."""
    c = facts(spark, sf_dir).filter("relation_id = 'home'")
    made = lambda kind, **to: c.select(F.concat(F.lit(f"{kind}."), "subject_id").alias("id"), "relation_id", "subject_id", to.get("obj", F.col("object_id")).alias("object_id"), to.get("rel", F.lit("home")).alias("target_relation_id"), to.get("target", F.concat("subject_id", F.lit("x"))).alias("target_id"))
    out = made("ok").unionByName(made("fact", obj=F.concat("object_id", F.lit("x")))).unionByName(made("rel", rel=F.lit("sold_by"))).unionByName(made("self", target=F.col("subject_id")))
    out = out.unionByName(made("known", target=F.lit("supplier.0")).filter("subject_id <> 'supplier.0'"))
    return K.scenario_problems(out, facts(spark, sf_dir)).select("id", "problem")


@query(
    "wrong_object",
    f"""WITH {_FACTS}, o AS (SELECT relation_id, object_id, row_number() OVER (PARTITION BY relation_id ORDER BY md5(relation_id || '|' || object_id), object_id) AS k, count(*) OVER (PARTITION BY relation_id) AS n FROM (SELECT DISTINCT relation_id, object_id FROM f)),
 p AS (SELECT f.*, k, ('0x' || substr(md5('0|' || subject_id || '|' || f.relation_id || '|' || f.object_id), 1, 8))::BIGINT % (n - 1) + 1 AS pick FROM f JOIN o ON o.relation_id = f.relation_id AND o.object_id = f.object_id WHERE n > 1)
 SELECT subject_id, p.relation_id, p.object_id, o.object_id AS wrong_id FROM p JOIN o ON o.relation_id = p.relation_id AND o.k = CASE WHEN pick >= p.k THEN pick + 1 ELSE pick END""",
)
def wrong_object(spark, sf_dir):
    return K.wrong_objects(facts(spark, sf_dir))


@query("grammar_lookup", f"WITH {_NODES} SELECT id, CASE gender WHEN 'Masc' THEN 'do ' ELSE 'da ' END AS subject_of, CASE gender WHEN 'Masc' THEN 'o ' ELSE 'a ' END AS subject_the FROM n")
def grammar_lookup(spark, sf_dir):
    found = _grammar(spark, sf_dir)
    return found.select("id", F.element_at("forms", "subject_of").alias("subject_of"), F.element_at("forms", "subject_the").alias("subject_the"))


@query("template_problems", f"SELECT * FROM (VALUES {_values([(t[0], '') for t in TEMPLATES] + FAULTS)}) v(id, problems)")
def template_problems(spark, sf_dir):
    """What is wrong with each template; the templates are written by hand, as they are everywhere."""
    return K.template_problems(templates(spark, TEMPLATES + FAULTY)).select("id", F.array_join("problems", ",").alias("problems"))


#: Relation tables by rule: relation, table, subject and answer columns, and questions in each language.
TABLES = [
    ("nation_region", "SELECT n_name AS subject, r_name AS answer FROM nation JOIN region ON n_regionkey = r_regionkey", {"en": ["in which region is {subject}?", "{subject} is in which region?"], "pt": ["em que região fica {subject}?"]}),
    ("supplier_nation", "SELECT s_name AS subject, n_name AS answer FROM supplier JOIN nation ON s_nationkey = n_nationkey", {"en": ["where is {subject}?"], "pt": ["onde fica {subject}?"]}),
    ("customer_nation", "SELECT c_name AS subject, n_name AS answer FROM customer JOIN nation ON c_nationkey = n_nationkey", {"en": ["where does {subject} live?"], "pt": ["onde mora {subject}?"]}),
    ("customer_segment", "SELECT c_name AS subject, c_mktsegment AS answer FROM customer", {"en": ["which segment is {subject} in?"], "pt": ["qual é o segmento de {subject}?"]}),
    ("part_brand", "SELECT concat(p_name, ' ', p_partkey) AS subject, p_brand AS answer FROM part", {"en": ["who makes {subject}?"], "pt": ["quem faz {subject}?"]}),
    ("part_type", "SELECT concat(p_name, ' ', p_partkey) AS subject, p_type AS answer FROM part", {"en": ["of what type is {subject}?"], "pt": ["de que tipo é {subject}?"]}),
    ("order_status", "SELECT concat('order ', o_orderkey) AS subject, o_orderstatus AS answer FROM orders", {"en": ["what is the status of {subject}?"], "pt": ["qual é o estado de {subject}?"]}),
]
QUESTIONS = [(name, lang, q) for name, _, asked in TABLES for lang, qs in asked.items() for q in qs]


def pairs(spark, sf_dir):
    """relation, language, subject, answer of the seven relations."""
    views = {n: table(spark, sf_dir, n) for n in ("nation", "region", "supplier", "customer", "part", "orders")}
    n, r, s, c, p, o = (views[x] for x in ("nation", "region", "supplier", "customer", "part", "orders"))
    item = F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string"))
    found = {
        "nation_region": n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("subject"), F.col("r_name").alias("answer")),
        "supplier_nation": s.join(n, s.s_nationkey == n.n_nationkey).select(F.col("s_name").alias("subject"), F.col("n_name").alias("answer")),
        "customer_nation": c.join(n, c.c_nationkey == n.n_nationkey).select(F.col("c_name").alias("subject"), F.col("n_name").alias("answer")),
        "customer_segment": c.select(F.col("c_name").alias("subject"), F.col("c_mktsegment").alias("answer")),
        "part_brand": p.select(item.alias("subject"), F.col("p_brand").alias("answer")),
        "part_type": p.select(item.alias("subject"), F.col("p_type").alias("answer")),
        "order_status": o.select(F.concat(F.lit("order "), F.col("o_orderkey")).alias("subject"), F.col("o_orderstatus").alias("answer")),
    }
    out = None
    for name, rows in found.items():
        one = rows.select(F.lit(name).alias("relation"), F.explode(F.array(F.lit("en"), F.lit("pt"))).alias("language"), "subject", "answer")
        out = one if out is None else out.unionByName(one)
    return out


def questions(spark, rows=QUESTIONS):
    return spark.createDataFrame(rows, "relation string, language string, template string")


_PAIRS = "p AS (" + " UNION ALL ".join(f"SELECT '{name}' AS relation, l AS language, subject, answer FROM ({sql}), (VALUES ('en'), ('pt')) v(l)" for name, sql, _ in TABLES) + ")"


@query(
    "relation_cross",
    f"WITH {_PAIRS}, q(relation, language, template) AS (VALUES {_values(QUESTIONS)}), j AS (SELECT *, replace(template, '{{subject}}', subject) AS x, row_number() OVER (PARTITION BY relation, language ORDER BY md5(subject || '|' || template), subject, template) AS k FROM p JOIN q USING (relation, language)) SELECT relation || '_' || language || '_' || lpad(CAST(k AS VARCHAR), CAST(greatest(5, length(CAST(k AS VARCHAR))) AS INT), '0') AS id, 'knowledge_completion' AS category, language, 'stage0' AS stage, upper(left(x, 1)) || substr(x, 2) AS question, answer FROM j",
)
def relation_cross(spark, sf_dir):
    return K.relation_table(pairs(spark, sf_dir), questions(spark))


@query("relation_problems", f"WITH {_PAIRS} SELECT 'part_type' AS relation, 'pt' AS language, 'no_template' AS problem UNION ALL SELECT 'order_status', 'en', 'no_subject' WHERE (SELECT count(*) FROM p) > 0")
def relation_problems(spark, sf_dir):
    """The relations with one language's questions left out, and a question that does not name its subject."""
    faulty = [q for q in QUESTIONS if q[:2] != ("part_type", "pt")] + [("order_status", "en", "what is the status?")]
    return K.relation_problems(pairs(spark, sf_dir), questions(spark, faulty))


@query(
    "stage0_report",
    f"WITH {_NODES}, {_REL}, {_FACTS}, {_T}, {_COMPILED}, {_SCENARIO}, a AS (SELECT CASE WHEN category = 'instruction_following' THEN 'homes_upper' WHEN relation_id = 'home' THEN 'homes' ELSE 'regions' END AS build, category, language FROM c UNION ALL SELECT 'unsold', category, language FROM sc UNION ALL SELECT 'static', category, language FROM t WHERE relation_id IS NULL) SELECT build, category, language, count(*) AS rows FROM a GROUP BY ALL",
)
def stage0_report(spark, sf_dir):
    """Rows of every build by category and language."""
    return K.built(BUILDS, _with_forms(spark, sf_dir), templates(spark)).groupBy("build", "category", "language").agg(F.count("*").alias("rows"))
