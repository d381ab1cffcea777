"""Registered queries over the memory graph: activation, retrieval, ingestion, upkeep and what readers ask of it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import text as T
from ..operators import graph as G
from ..operators import memory as M
from .queries import _EDGES, _NODES, _REACHED, _ROWS, NOW, _edges, _nodes, _walks, query, r6, remembered, table


def _name(letter: str, column: str):
    return F.concat(F.lit(letter), F.col(column).cast("string"))


# nodes with what visibility, age and rendering need
_FULL = f"""{_NODES}, full_ AS (SELECT id, kind, strength, substr(id, 2)::BIGINT AS n, ['u' || (substr(id, 2)::BIGINT % 5), 'u' || (substr(id, 2)::BIGINT % 3)] AS owners, substr(id, 2)::BIGINT % 11 = 0 AS character_scoped,
    kind = 'fact' AND substr(id, 2)::BIGINT % 4 = 1 AS internal, CASE WHEN kind = 'person' THEN 'u' || (substr(id, 2)::BIGINT % 97) END AS user_id,
    1706745600 - 86400.0::DOUBLE * (substr(id, 2)::BIGINT % 30) - 60 AS created_at FROM nodes)"""


def _full(spark, d):
    n = F.expr("cast(substring(id, 2) as bigint)")
    u = lambda k: F.concat(F.lit("u"), (F.col("n") % k).cast("string"))
    out = _nodes(spark, d).withColumn("n", n)
    out = out.withColumns({"owners": F.array(u(5), u(3)), "character_scoped": F.col("n") % 11 == 0, "internal": (F.col("kind") == "fact") & (F.col("n") % 4 == 1), "user_id": F.when(F.col("kind") == "person", u(97))})
    created = NOW - 86_400.0 * (F.col("n") % 30) - 60
    return out.withColumn("created_at", created).withColumn("base_level", S.base_level(NOW, created, F.lit(0)))


_BASE = "greatest(-2, ln(pow(1706745600 - created_at, -0.5) * exp(-(1706745600 - created_at) / 1209600)))"
# the seeds of one query and the bias of the viewer u7, the spread over two hops, and what the viewer sees
_TRACE = f"""{_REACHED}, {_FULL.replace(_NODES + ', ', '')}, s0 AS (SELECT 'c' || c_custkey AS id, 0.8::DOUBLE AS mass FROM customer WHERE c_custkey % 20 = 0 UNION ALL (SELECT id, 0.48::DOUBLE FROM full_ WHERE user_id = 'u7' ORDER BY id LIMIT 1)),
    f0 AS (SELECT id, sum(mass) AS mass FROM s0 GROUP BY id), f1 AS (SELECT r.dst AS id, sum(0.35 * f.mass * r.strength / n.fan) AS mass FROM f0 f JOIN reached r ON r.src = f.id JOIN fans n ON n.src = f.id GROUP BY r.dst),
    f2 AS (SELECT r.dst AS id, sum({0.35 * 0.6!r} * f.mass * r.strength / n.fan) AS mass FROM f1 f JOIN reached r ON r.src = f.id JOIN fans n ON n.src = f.id GROUP BY r.dst),
    a AS (SELECT id, sum(mass) AS activation FROM (SELECT * FROM f0 UNION ALL SELECT * FROM f1 UNION ALL SELECT * FROM f2) GROUP BY id),
    trace AS (SELECT v.id, {_BASE} AS base_level, coalesce(f0.mass, 0) AS seed, coalesce(a.activation, 0) AS activation, {_BASE} + 1.2 * coalesce(a.activation, 0) AS score
              FROM full_ v LEFT JOIN a ON a.id = v.id LEFT JOIN f0 ON f0.id = v.id WHERE NOT internal AND (character_scoped OR list_contains(owners, 'u7') OR list_contains(owners, 'u2')))"""


def _trace(spark, d):
    seeds = table(spark, d, "customer").where("c_custkey % 20 = 0").select(_name("c", "c_custkey").alias("id"), F.lit(0.8).alias("activation"))
    return G.activation_trace(_full(spark, d), _walks(spark, d), seeds, viewers=["u7", "u2"])


def _seeded(sql: str) -> str:
    """Two viewers: u7 names a person, u2 another one."""
    one = "(SELECT id, 0.48::DOUBLE FROM full_ WHERE user_id = 'u7' ORDER BY id LIMIT 1)"
    return sql.replace(one, f"{one} UNION ALL {one.replace('u7', 'u2')}")


@query(_seeded(f"WITH {_TRACE} SELECT id, round(base_level, 6) AS base_level, round(seed, 6) AS seed, round(activation + 1e-10, 6) AS activation, round(score + 1e-10, 6) AS score FROM trace"))
def activation_trace(spark, d):
    return _trace(spark, d).select("id", r6("base_level").alias("base_level"), r6("seed").alias("seed"), r6(F.col("activation") + 1e-10).alias("activation"), r6(F.col("score") + 1e-10).alias("score"))


@query(_seeded(f"""WITH {_TRACE}, t AS (SELECT id, 'node ' || id AS text, round(score, 6) AS score FROM trace WHERE round(score, 6) >= -1.9), c AS (SELECT *, ceil(length('- ' || text) / 4)::BIGINT AS k FROM t),
    u AS (SELECT *, sum(k) OVER (ORDER BY score DESC, id DESC ROWS UNBOUNDED PRECEDING)::BIGINT AS used_tokens, row_number() OVER (ORDER BY score DESC, id DESC) AS position FROM c)
    SELECT id, text, score, position, used_tokens FROM u WHERE used_tokens <= 200"""))
def graph_retrieve(spark, d):
    trace = _trace(spark, d).withColumn("score", r6("score"))
    texts = _nodes(spark, d).select("id", F.concat(F.lit("node "), "id").alias("text"))
    return G.retrieved(trace, texts, least=-1.9, budget=200)


# the recall above, recorded: what surfaced is touched, and wires together with what surfaced beside it
_SURFACED = f"""{_TRACE}, t AS (SELECT id, 'node ' || id AS text, round(score, 6) AS score FROM trace WHERE round(score, 6) >= -1.9), c AS (SELECT *, ceil(length('- ' || text) / 4)::BIGINT AS k FROM t),
    u AS (SELECT *, sum(k) OVER (ORDER BY score DESC, id DESC ROWS UNBOUNDED PRECEDING)::BIGINT AS used_tokens FROM c), shown AS (SELECT id, score FROM u WHERE used_tokens <= 200)"""


def _fed_back(spark, d):
    trace = _trace(spark, d).withColumn("score", r6("score"))
    shown = G.retrieved(trace, _nodes(spark, d).select("id", F.concat(F.lit("node "), "id").alias("text")), least=-1.9, budget=200)
    n = F.expr("cast(substring(id, 2) as bigint)")
    nodes = _nodes(spark, d).select("id", (n % 4).alias("recall_count"), F.lit(None).cast("double").alias("last_recalled"))
    lines = table(spark, d, "lineitem").select(_name("o", "l_orderkey").alias("a"), _name("p", "l_partkey").alias("b")).distinct()
    pairs = lines.select("a", "b", F.lit(0.3).alias("weight"), F.lit(0.15).alias("creation_weight"), F.lit(2).cast("long").alias("co_recall_count")).withColumnsRenamed({"a": "src", "b": "dst"})
    return G.fed_back(nodes, pairs, shown, NOW, threshold=-1.5)


@query(_seeded(f"WITH {_SURFACED} SELECT n.id, substr(n.id, 2)::BIGINT % 4 + CASE WHEN s.id IS NULL THEN 0 ELSE 1 END AS recall_count, CASE WHEN s.id IS NOT NULL THEN 1706745600.0::DOUBLE END AS last_recalled FROM nodes n LEFT JOIN shown s ON s.id = n.id"))
def touched_nodes(spark, d):
    return _fed_back(spark, d)[0]


@query(_seeded(f"""WITH {_SURFACED}, old AS (SELECT DISTINCT 'o' || l_orderkey AS src, 'p' || l_partkey AS dst FROM lineitem), fired AS (SELECT a.id AS src, b.id AS dst FROM shown a JOIN shown b ON a.id < b.id WHERE a.score >= -1.5 AND b.score >= -1.5)
    SELECT coalesce(o.src, f.src) AS src, coalesce(o.dst, f.dst) AS dst, round(CASE WHEN o.src IS NULL THEN 0.1 WHEN f.src IS NULL THEN 0.3 ELSE 0.25 END::DOUBLE, 6) AS weight, CASE WHEN o.src IS NULL THEN 1 WHEN f.src IS NULL THEN 2 ELSE 3 END::BIGINT AS co_recall_count FROM old o FULL JOIN fired f ON o.src = f.src AND o.dst = f.dst"""))
def wired_pairs(spark, d):
    return _fed_back(spark, d)[1].select("src", "dst", r6("weight").alias("weight"), "co_recall_count")


@query(f"""WITH {_FULL}, {_EDGES}, v AS (SELECT * FROM full_ WHERE NOT internal AND (character_scoped OR list_contains(owners, 'u2'))), x AS (SELECT e.kind FROM edges e JOIN v a ON a.id = e.src JOIN v b ON b.id = e.dst)
    SELECT 'nodes' AS what, kind, count(*) AS n FROM v GROUP BY kind UNION ALL SELECT 'edges', kind, count(*) FROM x GROUP BY kind UNION ALL SELECT 'users', NULL, count(DISTINCT user_id) FROM v""")
def graph_overview(spark, d):
    return G.overview(_full(spark, d), _edges(spark, d), ["u2"])


@query(f"""WITH {_FULL}, m AS (SELECT 'o' || o_orderkey AS id, CASE WHEN o_custkey % 4 > 0 THEN 'u' || (o_custkey % 9) END AS user_id FROM orders), g AS (SELECT id, list(DISTINCT user_id) FILTER (user_id IS NOT NULL) AS us, bool_or(user_id IS NULL) AS every FROM m GROUP BY id)
    SELECT f.id, array_to_string(list_sort(list_distinct(list_concat(owners, coalesce(us, [])))), ',') AS owners, character_scoped OR coalesce(every, false) AS character_scoped FROM full_ f LEFT JOIN g ON g.id = f.id""")
def scope_marks(spark, d):
    marks = table(spark, d, "orders").select(_name("o", "o_orderkey").alias("id"), F.when(F.col("o_custkey") % 4 > 0, F.concat(F.lit("u"), (F.col("o_custkey") % 9).cast("string"))).alias("user_id"))
    return G.scoped(_full(spark, d), marks).select("id", F.array_join(F.array_sort("owners"), ",").alias("owners"), "character_scoped")


@query("""WITH n AS (SELECT 'p' || p_partkey AS id, unnest(['b:' || p_brand, 's:' || p_size]) AS ref FROM part), w AS (SELECT DISTINCT 's:' || l_linenumber AS ref FROM lineitem UNION SELECT 'b:Brand#13')
    SELECT ref, min(id) AS id FROM n WHERE ref IN (SELECT ref FROM w) GROUP BY ref""")
def external_refs(spark, d):
    nodes = table(spark, d, "part").select(_name("p", "p_partkey").alias("id"), F.array(_name("b:", "p_brand"), _name("s:", "p_size")).alias("external_refs"))
    refs = table(spark, d, "lineitem").select(_name("s:", "l_linenumber").alias("ref")).unionByName(spark.createDataFrame([("b:Brand#13",)], "ref string"))
    return G.by_external_ref(nodes, refs)


@query(f"""WITH {_ROWS} SELECT id, CASE WHEN id % 3 = 0 THEN created_at WHEN id % 4 = 0 THEN id * 10.0::DOUBLE END AS start, CASE WHEN id % 3 <> 0 AND id % 4 = 0 THEN id * 10.0::DOUBLE + 5 END AS "end" FROM rows_""")
def node_intervals(spark, d):
    rows = remembered(spark, d)
    nodes = rows.select("id", F.when(F.col("id") % 3 == 0, "episode").otherwise("fact").alias("kind"), F.col("created_at").alias("timestamp"), _name("calendar:", "id").alias("source"))
    sources = rows.where("id % 4 = 0").select(_name("calendar:", "id").alias("source"), (F.col("id") * 10.0).alias("start"), (F.col("id") * 10.0 + 5).alias("end"))
    return G.temporal_intervals(nodes, sources)


@query("""WITH n AS (SELECT doc_id AS id, ['person', 'fact', 'episode', 'entity'][doc_id % 4 + 1] AS kind, text, CASE WHEN doc_id % 3 = 0 THEN source ELSE '  ' END AS name, CASE WHEN doc_id % 7 = 0 THEN 'wiki:' || doc_id ELSE 'row:' || doc_id END AS src, CASE WHEN doc_id % 2 = 0 THEN lang END AS label FROM documents)
    SELECT id, CASE WHEN starts_with(src, 'wiki') THEN '[wiki] ' || coalesce(nullif(trim(text), ''), '') WHEN kind = 'person' THEN concat_ws(': ', nullif(trim(name), ''), nullif(trim(text), '')) WHEN kind = 'fact' THEN '[' || coalesce(label, 'fact') || '] ' || coalesce(nullif(trim(text), ''), '')
        WHEN kind = 'episode' THEN '[episode] ' || coalesce(nullif(trim(text), ''), '') ELSE coalesce(nullif(trim(text), ''), nullif(trim(name), ''), '') END AS text FROM n""")
def node_texts(spark, d):
    k = F.col("doc_id")
    n = table(spark, d, "documents").select(
        k.alias("id"), F.get(F.array(*map(F.lit, ["person", "fact", "episode", "entity"])), (k % 4).cast("int")).alias("kind"), "text", F.when(k % 3 == 0, F.col("source")).otherwise("  ").alias("name"),
        F.when(k % 7 == 0, _name("wiki:", "doc_id")).otherwise(_name("row:", "doc_id")).alias("src"), F.when(k % 2 == 0, F.col("lang")).alias("label"),
    )
    return n.select("id", G.node_text(F.col("kind"), F.col("text"), F.col("name"), F.col("src"), F.lit(None).cast("string"), F.col("label")).alias("text"))


@query("SELECT CASE WHEN doc_id = 3 THEN 'self' ELSE 'n' || doc_id END AS id, trim(text) AS text FROM documents WHERE trim(text) <> '' AND doc_id <> 3")
def graph_chunks(spark, d):
    nodes = table(spark, d, "documents").select(F.when(F.col("doc_id") == 3, "self").otherwise(_name("n", "doc_id")).alias("id"), "text")
    return G.text_chunks(nodes)


@query("""SELECT 'person:' || c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN c_custkey::VARCHAR ELSE c_name END AS name, c_mktsegment AS text FROM customer""")
def summary_nodes(spark, d):
    k = F.col("c_custkey")
    profiles = table(spark, d, "customer").select(k.cast("string").alias("user_id"), F.when(k % 5 > 0, F.col("c_name")).otherwise(" ").alias("name"), F.array().cast("array<string>").alias("aliases"), F.col("c_mktsegment").alias("summary"))
    return G.summaries_graph(profiles).select("id", "name", "text")


@query("""WITH e AS (SELECT vec_id, (abs(embedding[1]::DOUBLE) + abs(embedding[2]::DOUBLE)) / 2 AS m FROM embeddings) SELECT 'e:relation:self->person:' || vec_id AS id, 'person:' || vec_id AS dst, round(greatest(0.2, least(1, 0.3 + 0.7 * m)), 6) AS weight FROM e""")
def relation_edges(spark, d):
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("user_id"), F.create_map(F.lit("trust"), at(0), F.lit("affection"), at(1)).alias("dims"))
    return G.emotion_graph(e).select("id", "dst", r6("weight").alias("weight"))


@query("""WITH n AS (SELECT conv_id * 10 + turn AS id, conv_id AS chat FROM conversations WHERE role <> 'system')
    SELECT 'e:chat:' || least(a.id::VARCHAR, b.id::VARCHAR) || '::' || greatest(a.id::VARCHAR, b.id::VARCHAR) AS id, a.id AS src, b.id AS dst, 0.1::DOUBLE AS weight FROM n a JOIN n b ON a.chat = b.chat AND a.id < b.id""")
def chat_edges(spark, d):
    kind = F.when(F.col("role") == "user", "fact").when(F.col("role") == "assistant", "episode").otherwise("person")
    nodes = table(spark, d, "conversations").select((F.col("conv_id") * 10 + F.col("turn")).alias("id"), F.col("conv_id").alias("chat_id"), kind.alias("kind"))
    return G.chat_edges(nodes).select("id", "src", "dst", "weight")


_KG = """kn AS (SELECT 'd' || doc_id AS id, 'fact' AS kind, text, CASE WHEN doc_id % 5 = 0 THEN 'wiki:' || doc_id ELSE 'row:' || doc_id END AS source FROM documents),
    ke AS (SELECT 'e' || doc_id AS id, 'd' || doc_id AS src, 'd' || (doc_id // 2) AS dst FROM documents)"""


def _kg(spark, d):
    k = F.col("doc_id")
    docs = table(spark, d, "documents")
    nodes = docs.select(_name("d", "doc_id").alias("id"), F.lit("fact").alias("kind"), "text", F.when(k % 5 == 0, _name("wiki:", "doc_id")).otherwise(_name("row:", "doc_id")).alias("source"), F.lit(0.5).alias("importance"))
    edges = docs.select(_name("e", "doc_id").alias("id"), F.lit("fact").alias("kind"), _name("d", "doc_id").alias("src"), F.concat(F.lit("d"), F.expr("doc_id div 2").cast("string")).alias("dst"), F.lit(0.5).alias("weight"))
    return nodes, edges


@query(f"""WITH {_KG}, left_ AS (SELECT id FROM kn WHERE NOT starts_with(source, 'wiki:')) SELECT 'node' AS what, id FROM left_ UNION ALL SELECT 'node', 'fact:wiki:' || item_id FROM benchmark WHERE trim(text) <> ''
    UNION ALL SELECT 'edge', id FROM ke WHERE src IN (SELECT id FROM left_) AND dst IN (SELECT id FROM left_) UNION ALL SELECT 'edge', 'e:fact:self->fact:wiki:' || item_id FROM benchmark WHERE trim(text) <> ''""")
def wiki_projection(spark, d):
    sections = table(spark, d, "benchmark").select(F.col("item_id").alias("section"), F.lit("Title").alias("title"), "text")
    nodes, edges = G.wiki_graph(sections, *_kg(spark, d))
    return nodes.select(F.lit("node").alias("what"), "id").unionByName(edges.select(F.lit("edge").alias("what"), "id"))


@query(f"""WITH {_KG}, left_ AS (SELECT id, CASE WHEN substr(id, 2)::BIGINT % 9 = 1 THEN 'new' ELSE text END AS text FROM kn WHERE substr(id, 2)::BIGINT % 9 <> 0 OR starts_with(source, 'wiki:'))
    SELECT 'node' AS what, id, text FROM (SELECT l.id, CASE WHEN starts_with(source, 'wiki:') THEN kn.text ELSE l.text END AS text FROM left_ l JOIN kn ON kn.id = l.id) UNION ALL SELECT 'edge', id, '' FROM ke WHERE src IN (SELECT id FROM left_) AND dst IN (SELECT id FROM left_)""")
def graph_after_dedup(spark, d):
    rows = table(spark, d, "documents")
    report = rows.where("doc_id % 9 < 2").select(_name("row:", "doc_id").alias("source"), F.when(F.col("doc_id") % 9 == 0, "removed").otherwise("merged").alias("action"))
    changed = rows.select(_name("row:", "doc_id").alias("source"), F.lit("new").alias("text"), F.lit(0.9).alias("importance"))
    nodes, edges = G.deduplicated(*_kg(spark, d), report, changed)
    return nodes.select(F.lit("node").alias("what"), "id", "text").unionByName(edges.select(F.lit("edge").alias("what"), "id", F.lit("").alias("text")))


@query("SELECT 'src' || doc_id AS source FROM documents WHERE doc_id % 3 = 0 AND doc_id % 4 <> 1")
def unchanged_sources(spark, d):
    k, rows = F.col("doc_id"), table(spark, d, "documents")
    side = lambda version, text: rows.select(_name("src", "doc_id").alias("source"), version.alias("version"), F.sha2(text, 256).alias("fingerprint"))
    return G.unchanged_sources(side(k % 3, F.col("text")), side(F.lit(0).cast("long"), F.when(k % 4 == 1, F.concat("text", F.lit("."))).otherwise(F.col("text"))))


@query(f"WITH {_ROWS} SELECT user_id AS recall, id % 50 AS id, round(max(importance), 6) AS activation FROM rows_ GROUP BY ALL")
def recalled_groups(spark, d):
    items = remembered(spark, d).select(F.col("user_id").alias("recall"), F.col("type").alias("participant"), (F.col("id") % 50).alias("id"), F.col("importance").alias("activation"))
    return G.recalled_group(items).select("recall", "id", r6("activation").alias("activation"))


@query("""WITH p AS (SELECT 0 AS at_, 'person:' || c_custkey AS id, c_mktsegment AS text, 'u' || c_custkey AS owner FROM customer UNION ALL SELECT 1, 'person:' || o_custkey, o_orderstatus, 'o' || o_orderkey FROM orders)
    SELECT id, arg_min(text, at_) FILTER (at_ = 0) AS text, array_to_string(list_sort(list(DISTINCT owner)), ',') AS owners FROM p GROUP BY id""")
def full_graph(spark, d):
    node = lambda t, k, text, owner: table(spark, d, t).select(_name("person:", k).alias("id"), F.col(text).alias("text"), F.array(owner).alias("owners"))
    edge = table(spark, d, "orders").select(_name("e", "o_orderkey").alias("id"), F.lit("episode").alias("kind"), _name("person:", "o_custkey").alias("src"), _name("o", "o_orderkey").alias("dst"), F.lit(0.5).alias("weight"))
    nodes, _ = G.merged_graph([(node("customer", "c_custkey", "c_mktsegment", _name("u", "c_custkey")), edge.limit(0)), (node("orders", "o_custkey", "o_orderstatus", _name("o", "o_orderkey")), edge)])
    return nodes.select("id", "text", F.array_join("owners", ",").alias("owners"))


@query(f"""WITH {_KG}, n AS (SELECT substr(id, 2)::BIGINT AS k, id, text FROM kn) SELECT 'node' AS what, id, text, 'u' || (k % 12) AS owners, k::DOUBLE AS n FROM n WHERE k % 6 <> 0
    UNION ALL SELECT 'node', id, 'changed', CASE WHEN k % 12 = 0 THEN 'u0' ELSE 'u6,u0' END, k::DOUBLE FROM n WHERE k % 6 = 0 UNION ALL SELECT 'node', 'x' || item_id, 'fresh', 'u0', 7.0 FROM benchmark
    UNION ALL SELECT 'edge', id, dst, src, CASE WHEN substr(id, 2)::BIGINT % 5 = 0 THEN 0.75 ELSE 0.5 END FROM ke UNION ALL SELECT 'edge', 'y' || item_id, 'self', 'x' || item_id, 0.25 FROM benchmark""")
def graph_update(spark, d):
    nodes, edges = _kg(spark, d)
    k, items = F.expr("cast(substring(id, 2) as bigint)"), table(spark, d, "benchmark")
    nodes = nodes.withColumn("owners", F.array(F.concat(F.lit("u"), (k % 12).cast("string")))).withColumn("recall_count", k)
    again = nodes.where(k % 6 == 0).withColumns({"text": F.lit("changed"), "owners": F.array(F.lit("u0")), "recall_count": F.lit(7).cast("long")})
    fresh = items.select(_name("x", "item_id").alias("id"), F.lit("fact").alias("kind"), F.lit("fresh").alias("text"), F.lit(None).cast("string").alias("source"), F.lit(0.5).alias("importance"), F.array(F.lit("u0")).alias("owners"), F.lit(7).cast("long").alias("recall_count"))
    heavier = edges.where(k % 5 == 0).withColumn("weight", F.lit(0.75)).unionByName(edges.where(k % 5 == 1).withColumn("weight", F.lit(0.1)))
    links = items.select(_name("y", "item_id").alias("id"), F.lit("fact").alias("kind"), _name("x", "item_id").alias("src"), F.lit("self").alias("dst"), F.lit(0.25).alias("weight"))
    new_nodes, new_edges = G.updated_graph(nodes, edges, (again.unionByName(fresh), heavier.unionByName(links)))
    own = new_nodes.select(F.lit("node").alias("what"), "id", "text", F.array_join("owners", ",").alias("owners"), F.col("recall_count").cast("double").alias("n"))
    return own.unionByName(new_edges.select(F.lit("edge").alias("what"), "id", F.col("dst").alias("text"), F.col("src").alias("owners"), F.col("weight").alias("n")))


@query(f"""WITH {_EDGES}, e AS (SELECT row_number() OVER () AS k, src, dst FROM edges WHERE src <> dst), b AS (SELECT k, src AS id, dst AS neighbour FROM e UNION ALL SELECT k, dst, src FROM e)
    SELECT id, neighbour, count(*) AS edges FROM b WHERE id IN (SELECT 'c' || c_custkey FROM customer WHERE c_custkey % 20 = 0) OR id IN (SELECT 'p' || p_partkey FROM part WHERE p_partkey % 20 = 0) GROUP BY ALL""")
def incident_edges(spark, d):
    edges = _edges(spark, d).withColumn("id", F.monotonically_increasing_id())
    ids = table(spark, d, "customer").where("c_custkey % 20 = 0").select(_name("c", "c_custkey").alias("id")).unionByName(table(spark, d, "part").where("p_partkey % 20 = 0").select(_name("p", "p_partkey").alias("id")))
    return G.neighbours(edges, ids).groupBy("id", "neighbour").agg(F.count("*").alias("edges"))


@query("""WITH e AS (SELECT 'c' || (o_custkey // 2 * 2) AS src, 'o' || (o_orderkey // 3 * 3) AS dst, 'r' || o_orderkey AS id FROM orders), n AS (SELECT *, 'e:episode:' || src || '->' || dst AS want FROM e),
    k AS (SELECT *, row_number() OVER (PARTITION BY want ORDER BY id) - 1 AS n FROM n) SELECT CASE WHEN n = 0 THEN want ELSE want || '::m' || n END AS id, src, dst FROM k""")
def rewired_edges(spark, d):
    orders = table(spark, d, "orders")
    edges = orders.select(_name("r", "o_orderkey").alias("id"), F.lit("episode").alias("kind"), _name("c", "o_custkey").alias("src"), _name("o", "o_orderkey").alias("dst"))
    to = lambda letter, k, by: F.concat(F.lit(letter), F.expr(f"{k} div {by} * {by}").cast("string"))
    moves = orders.select(_name("c", "o_custkey").alias("id"), to("c", "o_custkey", 2).alias("survivor")).distinct().unionByName(orders.select(_name("o", "o_orderkey").alias("id"), to("o", "o_orderkey", 3).alias("survivor")))
    return G.rewired(edges, moves.where("id <> survivor")).select("id", "src", "dst")


@query("""WITH p AS (SELECT c_custkey AS id, c_custkey // 6 AS component, floor(abs(c_acctbal))::INT % 3 AS created_at, CASE WHEN c_custkey % 2 = 0 THEN 'u' WHEN c_custkey % 3 = 0 THEN 'U7' END AS user_id, c_mktsegment AS name FROM customer)
    SELECT id, first(id) OVER (PARTITION BY component ORDER BY CASE WHEN created_at = 0 THEN 9 ELSE created_at END, NOT regexp_matches(coalesce(user_id, ''), '[0-9A-Z]'), -length(name), id) AS survivor FROM p""")
def merge_survivors(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.expr("c_custkey div 6").alias("component"), (F.floor(F.abs("c_acctbal")).cast("int") % 3).alias("created_at"), F.when(F.col("c_custkey") % 2 == 0, "u").when(F.col("c_custkey") % 3 == 0, "U7").alias("user_id"), F.col("c_mktsegment").alias("name"))
    return G.survivors(c.drop("component"), c.select("id", "component"))


# persons that share names or user ids in runs, with edges to their orders
_PERSONS = """pn AS (SELECT 'c' || c_custkey AS id, c_custkey AS k, 'Name ' || repeat('x', (c_custkey % 4)::INT) || (c_custkey // 6 * 6 + c_custkey % 2) AS name, CASE WHEN c_custkey % 3 = 0 THEN 'user' || (c_custkey // 3) ELSE 'slug' END AS raw, 'Al' || (c_custkey // 3) AS alias, (c_custkey % 5)::DOUBLE AS born FROM customer),
    pl AS (SELECT id, lower(unnest([name, alias, CASE WHEN raw = 'slug' THEN 'slug' || k ELSE raw END])) AS label FROM pn), pe AS (SELECT DISTINCT a.id AS a, b.id AS b FROM pl a JOIN pl b USING (label)),
    pr(id, root) AS (SELECT id, id FROM pn UNION SELECT pe.b, pr.root FROM pr JOIN pe ON pe.a = pr.id WHERE pr.root < pe.b), pc AS (SELECT id, min(root) AS component FROM pr GROUP BY id),
    ps AS (SELECT pn.*, component, CASE WHEN raw = 'slug' THEN 'slug' || k ELSE raw END AS user_id, first(pn.id) OVER (PARTITION BY component ORDER BY CASE WHEN born = 0 THEN 9 ELSE born END, false, -length(name), pn.id) AS survivor, count(*) OVER (PARTITION BY component) AS n FROM pn JOIN pc ON pc.id = pn.id)"""


def _merged_persons(spark, d):
    k = F.col("c_custkey")
    text = lambda n: n.cast("string")
    persons = table(spark, d, "customer").select(
        _name("c", "c_custkey").alias("id"), F.lit("person").alias("kind"), F.concat(F.lit("Name "), F.repeat(F.lit("x"), (k % 4).cast("int")), text(F.expr("c_custkey div 6 * 6 + c_custkey % 2"))).alias("name"),
        F.when(k % 3 == 0, F.concat(F.lit("user"), text(F.expr("c_custkey div 3")))).otherwise(F.concat(F.lit("slug"), text(k))).alias("user_id"), F.array(F.concat(F.lit("Al"), text(F.expr("c_custkey div 3")))).alias("aliases"), (k % 5).cast("double").alias("created_at"), F.array(_name("u", "c_custkey")).alias("owners"), F.lit("").alias("text"),
    )
    orders = table(spark, d, "orders")
    nodes = persons.unionByName(orders.select(_name("o", "o_orderkey").alias("id"), F.lit("episode").alias("kind")), allowMissingColumns=True)
    edges = orders.select(S.edge_id(F.lit("episode"), _name("c", "o_custkey"), _name("o", "o_orderkey")).alias("id"), F.lit("episode").alias("kind"), _name("c", "o_custkey").alias("src"), _name("o", "o_orderkey").alias("dst"), F.lit(0.5).alias("weight"))
    return G.merged_persons(nodes, edges)


@query(f"""WITH RECURSIVE {_PERSONS}, best AS (SELECT survivor, first(name ORDER BY -length(name), id <> survivor, id) AS name FROM ps WHERE n > 1 GROUP BY survivor),
    al AS (SELECT survivor, list_sort(list_distinct(list(x))) AS xs, list_sort(list_distinct(list(o))) AS os FROM (SELECT survivor, unnest([name, alias]) AS x, 'u' || k AS o FROM ps WHERE n > 1) GROUP BY survivor)
    SELECT ps.id, coalesce(best.name, ps.name) AS name, array_to_string(CASE WHEN best.name IS NULL THEN [alias] ELSE list_filter(xs, lambda x: x <> best.name) END, ',') AS aliases, array_to_string(coalesce(os, ['u' || k]), ',') AS owners FROM ps LEFT JOIN best ON best.survivor = ps.id LEFT JOIN al ON al.survivor = ps.id WHERE ps.id = ps.survivor""")
def merged_persons(spark, d):
    nodes = _merged_persons(spark, d)[0].where("kind = 'person'")
    return nodes.select("id", "name", F.array_join("aliases", ",").alias("aliases"), F.array_join("owners", ",").alias("owners"))


@query(f"""WITH RECURSIVE {_PERSONS} SELECT 'e:episode:' || survivor || '->o' || o_orderkey AS id, survivor AS src, 'o' || o_orderkey AS dst FROM orders JOIN ps ON ps.k = o_custkey""")
def merged_person_edges(spark, d):
    return _merged_persons(spark, d)[1].select("id", "src", "dst")


@query("SELECT 'c' || c_custkey AS id, 'self' AS survivor FROM customer WHERE c_mktsegment = 'FURNITURE' OR c_custkey % 10 = 3")
def self_merges(spark, d):
    persons = table(spark, d, "customer").select(_name("c", "c_custkey").alias("id"), F.col("c_mktsegment").alias("name"), F.array(F.concat(F.lit(" Alias "), (F.col("c_custkey") % 10).cast("string"))).alias("aliases"))
    return G.self_survivors(persons, ["Furniture", "alias 3"])


@query(f"WITH {_NODES}, {_EDGES} SELECT kind, count(*) AS n FROM nodes GROUP BY kind UNION ALL SELECT 'edges', count(*) FROM edges")
def graph_counts(spark, d):
    return G.counts(_nodes(spark, d), _edges(spark, d))


@query(f"""WITH {_NODES}, k AS (SELECT id, kind, round(strength, 6) AS score FROM nodes) SELECT id, row_number() OVER (ORDER BY list_position(['person', 'fact', 'episode', 'entity', 'self'], kind), score DESC, id) AS position FROM k QUALIFY position <= 50""")
def render_order(spark, d):
    from pyspark.sql import Window

    items = _nodes(spark, d).select("id", "kind", r6("strength").alias("score"))
    best = G.render_order(items).limit(50)
    place = F.array_position(F.array(*map(F.lit, ["person", "fact", "episode", "entity", "self"])), F.col("kind"))
    return best.select("id", F.row_number().over(Window.orderBy(place, F.desc("score"), "id")).alias("position"))


@query(f"""WITH {_ROWS} SELECT id, user_id FROM rows_ WHERE importance >= 0.6 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY importance DESC, created_at DESC, id DESC) <= 20""")
def heartbeat_projection(spark, d):
    rows = remembered(spark, d).withColumn("character", F.col("user_id"))
    return M.projected_heartbeats(rows, most=20).select("id", "user_id")


@query(f"""WITH {_ROWS} SELECT 'e:episode:person:' || user_id || '->episode:' || id AS id, round(greatest(0.3, least(1, 0.3 + 0.7 * least(1, sqrt(v * v)) + 0.3 * importance)), 6) AS weight FROM (SELECT *, (id % 10) / 10.0::DOUBLE AS v FROM rows_)""")
def episode_edges(spark, d):
    rows = remembered(spark, d).select(F.col("id").cast("string").alias("id"), F.col("user_id").cast("string").alias("user_id"), F.col("content").alias("summary"), "importance", F.create_map(F.lit("joy"), F.col("id") % 10 / 10.0).alias("emotional_shift"), F.lit(0.0).alias("occurred_at"), "created_at")
    return M.episode_graph(rows)[1].select("id", r6("weight").alias("weight"))


@query(f"""WITH {_FULL}, q AS (SELECT 'p' || (l_partkey) AS id FROM lineitem WHERE l_linenumber = 1) SELECT id, kind FROM full_ WHERE NOT internal AND (character_scoped OR list_contains(owners, 'u1')) AND id IN (SELECT id FROM q)""")
def fetched_nodes(spark, d):
    wanted = table(spark, d, "lineitem").where("l_linenumber = 1").select(_name("p", "l_partkey").alias("id"))
    return G.public(G.visible(_full(spark, d), ["u1"])).join(wanted, "id", "left_semi").select("id", "kind")


@query(f"""WITH {_ROWS} SELECT id, round(least((id % 30) / 20.0::DOUBLE, 0.2 + (id % 7) / 10.0::DOUBLE + 0.1), 6) AS weight FROM rows_""")
def capped_weights(spark, d):
    return remembered(spark, d).select("id", r6(S.hebbian_weight(F.col("id") % 30 / 20.0, 0.2 + F.col("id") % 7 / 10.0)).alias("weight"))


@query("SELECT doc_id, regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}_])' || lang || 'the($|[^\\p{L}\\p{N}_])') OR regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}_])the($|[^\\p{L}\\p{N}_])') AS mentioned FROM documents")
def label_mentions(spark, d):
    return table(spark, d, "documents").select("doc_id", F.coalesce(T.mentions(F.col("text"), F.concat("lang", F.lit("the"))) | T.mentions(F.col("text"), F.lit("The")), F.lit(None)).alias("mentioned"))


# a view of 60 nodes: 20 seeds, then in each step the neighbour with the most walks into the view
_VIEW = f"""{_NODES}, {_EDGES}, a AS (SELECT id, round(strength, 6) AS activation FROM nodes), f AS (SELECT id FROM a ORDER BY activation DESC, id LIMIT 20), w AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges WHERE kind = 'co_occurrence'),
    g AS (SELECT src, dst, count(*) AS n FROM w JOIN a x ON x.id = src JOIN a y ON y.id = dst WHERE src <> dst GROUP BY ALL),
    v AS (SELECT 0 AS step, (SELECT list(id ORDER BY id) FROM f) AS kept
          UNION ALL (SELECT step + 1, list_append(kept, y) FROM (SELECT v.step, v.kept, CASE WHEN list_contains(v.kept, g.src) THEN g.dst ELSE g.src END AS y, coalesce(sum(g.n) FILTER (list_contains(v.kept, g.dst)), 0) AS pull, bool_or(list_contains(v.kept, g.src)) AS reach
                     FROM v JOIN g ON list_contains(v.kept, g.src) <> list_contains(v.kept, g.dst) WHERE v.step < 40 GROUP BY ALL) c JOIN a ON a.id = c.y WHERE reach ORDER BY pull DESC, a.activation DESC, y LIMIT 1)),
    last_ AS (SELECT kept FROM v ORDER BY step DESC LIMIT 1), view_ AS (SELECT unnest(kept) AS id FROM last_)"""


def _view(spark, d):
    return G.grown_view(_nodes(spark, d).select("id", r6("strength").alias("activation")), _edges(spark, d), 60)


@query(f"""WITH RECURSIVE {_VIEW}, r AS (SELECT view_.id, activation, view_.id IN (SELECT id FROM f) AS seed FROM view_ JOIN a ON a.id = view_.id)
    SELECT id, activation, round((activation - min(activation) OVER ()) / CASE WHEN max(activation) OVER () > min(activation) OVER () THEN max(activation) OVER () - min(activation) OVER () ELSE 1 END, 6) AS activation_norm, seed FROM r""")
def graph_view(spark, d):
    return _view(spark, d).select("id", "activation", r6("activation_norm").alias("activation_norm"), "seed")


@query(f"""WITH RECURSIVE {_VIEW}, x AS (SELECT src || '>' || dst AS id, src, dst, round(weight, 6) AS weight FROM edges WHERE src IN (SELECT id FROM view_) AND dst IN (SELECT id FROM view_)) SELECT id, src, dst, weight FROM x QUALIFY row_number() OVER (ORDER BY abs(weight) DESC, id) <= 50""")
def graph_view_edges(spark, d):
    edges = _edges(spark, d).select(F.concat("src", F.lit(">"), "dst").alias("id"), "kind", "src", "dst", r6("weight").alias("weight"))
    return G.view_edges(_view(spark, d), edges, 50).select("id", "src", "dst", "weight")


@query("""SELECT 'person:' || c_custkey AS id, c_mktsegment AS text FROM customer""")
def projected_sources(spark, d):
    profiles = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("user_id"), F.col("c_name").alias("name"), F.array().cast("array<string>").alias("aliases"), F.col("c_mktsegment").alias("summary"))
    return G.projected({"profiles": profiles})[0].select("id", "text")


# messages as facts and episodes of their chats, with two participants each; the written pairs against groups
_CHATS = """m AS (SELECT conv_id * 10 + turn AS id, conv_id AS chat, (0.4 + (turn % 5) / 10.0)::DOUBLE AS strength, ['u' || (conv_id % 40), 'v' || ((turn * 7 + conv_id) % 25)] AS who FROM conversations WHERE role <> 'system'),
    w AS (SELECT a.id AS src, b.id AS dst, (0.1 * b.strength)::DOUBLE AS strength FROM m a JOIN m b ON a.chat = b.chat AND a.id <> b.id
          UNION ALL SELECT a.id, b.id, (0.15 * b.strength)::DOUBLE FROM m a JOIN m b ON a.id <> b.id AND list_has_any(a.who, b.who)
          UNION ALL SELECT id, id // 10 * 10, 0.5 FROM m),
    fan AS (SELECT src, count(*) AS fan FROM w GROUP BY src), s0 AS (SELECT chat % 5 AS team, id, 0.8::DOUBLE AS mass FROM m WHERE id % 7 = 0),
    who AS (SELECT DISTINCT chat % 5 AS team, chat % 12 AS member, 10 * (chat % 12) AS id, 0.48::DOUBLE AS bias FROM m)"""


def _chats(spark, d):
    m = table(spark, d, "conversations").where("role <> 'system'").select(
        (F.col("conv_id") * 10 + F.col("turn")).alias("id"), F.col("conv_id").alias("chat_id"), F.lit("fact").alias("kind"), (0.4 + F.col("turn") % 5 / 10.0).alias("strength"),
        F.array(F.concat(F.lit("u"), (F.col("conv_id") % 40).cast("string")), F.concat(F.lit("v"), ((F.col("turn") * 7 + F.col("conv_id")) % 25).cast("string"))).alias("participants"),
    )
    ways = m.select(F.col("id").alias("src"), F.expr("id div 10 * 10").alias("dst"), F.lit(0.5).alias("strength"))
    seeds = m.where("id % 7 = 0").select((F.col("chat_id") % 5).alias("team"), "id", F.lit(0.8).alias("activation"))
    return m, ways, G.chat_cliques(m).unionByName(G.shared_cliques(m)), seeds


def _hops(by: str) -> str:
    step = lambda a, b, rate: f"{b} AS (SELECT {by}, w.dst AS id, sum({rate!r} * x.mass * w.strength / fan) AS mass FROM {a} x JOIN w ON w.src = x.id JOIN fan ON fan.src = x.id GROUP BY ALL)"
    return f"{step('s1', 'h1', 0.35)}, {step('h1', 'h2', 0.35 * 0.6)} SELECT {by}, id, round(sum(mass) + 1e-10, 6) AS activation FROM (SELECT * FROM s1 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2) GROUP BY ALL"


@query(f"WITH {_CHATS}, s1 AS (SELECT team, id, sum(mass) AS mass FROM s0 GROUP BY ALL), {_hops('team')}")
def clique_spread(spark, d):
    _, ways, cliques, seeds = _chats(spark, d)
    return G.spread(ways, seeds, per=["team"], cliques=cliques).select("team", "id", r6(F.col("activation") + 1e-10).alias("activation"))


@query(f"WITH {_CHATS}, s1 AS (SELECT team, member, id, sum(mass) AS mass FROM (SELECT who.team, member, s0.id, mass FROM who JOIN s0 ON s0.team = who.team UNION ALL SELECT team, member, id, bias FROM who) GROUP BY ALL), {_hops('team, member')}")
def member_activation(spark, d):
    m, ways, cliques, seeds = _chats(spark, d)
    members = m.select((F.col("chat_id") % 5).alias("team"), (F.col("chat_id") % 12).alias("member"), (F.col("chat_id") % 12 * 10).alias("id"), F.lit(0.48).alias("activation")).distinct()
    out = G.spread_for_members(ways, seeds, members, group="team", cliques=cliques)
    return out.select("team", "member", "id", r6(F.col("activation") + 1e-10).alias("activation"))


# labels from the beginnings of texts, and common words of each language; journal rows from documents
_JOURNAL = """lab AS (SELECT 'person:' || doc_id AS node, regexp_extract(trim(text), '^\\S+ \\S+') AS label FROM documents WHERE doc_id % 50 = 1 UNION ALL SELECT 'entity:' || x, x FROM (SELECT unnest(['THE', 'die', 'le', 'que', 'sich ', 'e']) AS x)),
    rows_ AS (SELECT doc_id AS id, ['discovery', ' Action', 'other'][doc_id % 3 + 1] AS kind, text AS summary, (doc_id % 10) / 10.0::DOUBLE AS importance, (doc_id % 97)::DOUBLE AS created_at, source AS character FROM documents),
    adm AS (SELECT * FROM rows_ WHERE kind <> 'other' AND importance >= 0.6 QUALIFY row_number() OVER (PARTITION BY character ORDER BY importance DESC, created_at DESC, id DESC) <= 20),
    own AS (SELECT *, CASE WHEN kind = 'discovery' THEN 'fact' ELSE 'episode' END AS k, CASE WHEN kind = 'discovery' THEN 'fact:heartbeat:' ELSE 'episode:heartbeat:' END || id AS nid FROM adm WHERE trim(summary) <> ''),
    ends AS (SELECT nid, k, importance, 'self' AS e FROM own UNION SELECT nid, k, importance, node FROM own, lab WHERE length(trim(label)) >= 3 AND regexp_matches(lower(summary), '(^|[^\\p{L}\\p{N}_])' || regexp_escape(lower(trim(label))) || '($|[^\\p{L}\\p{N}_])')),
    old AS (SELECT 'fact:heartbeat:' || (doc_id * 3) AS id, doc_id FROM documents WHERE doc_id % 4 = 0), left_ AS (SELECT * FROM old WHERE id IN (SELECT nid FROM own))"""


def _journal(spark, d):
    k, docs = F.col("doc_id"), table(spark, d, "documents")
    names = docs.where("doc_id % 50 = 1").select(_name("person:", "doc_id").alias("node"), F.regexp_extract(F.trim("text"), r"^\S+ \S+", 0).alias("label"))
    labels = names.unionByName(spark.createDataFrame([(f"entity:{x}", x) for x in ("THE", "die", "le", "que", "sich ", "e")], "node string, label string"))
    rows = docs.select(k.alias("id"), F.get(F.array(*map(F.lit, ["discovery", " Action", "other"])), (k % 3).cast("int")).alias("kind"), F.col("text").alias("summary"), (k % 10 / 10).alias("importance"), (k % 97).cast("double").alias("created_at"), F.col("source").alias("character"))
    # an earlier projection: some nodes are wanted again, the others are stale
    old = docs.where("doc_id % 4 = 0").select(F.concat(F.lit("fact:heartbeat:"), (k * 3).cast("string")).alias("id"), F.lit("fact").alias("kind"), F.lit("old").alias("text"), F.concat(F.lit("heartbeat:"), (k * 3).cast("string")).alias("source"), F.array(F.lit("u1")).alias("owners"), (k + 1).alias("recall_count"), F.lit(False).alias("character_scoped"), F.lit(0.1).alias("importance"))
    fixed = labels.select(F.col("node").alias("id")).distinct().unionByName(spark.createDataFrame([("self",)], "id string"))
    nodes = old.unionByName(fixed.withColumn("kind", F.split("id", ":")[0]), allowMissingColumns=True)
    edges = old.select(F.concat(F.lit("x:"), "id").alias("id"), F.lit("fact").alias("kind"), F.lit("self").alias("src"), F.col("id").alias("dst"), F.lit(0.9).alias("weight")).unionByName(
        old.select(F.concat(F.lit("c:"), "id").alias("id"), F.lit("co_occurrence").alias("kind"), F.lit("self").alias("src"), F.col("id").alias("dst"), F.lit(0.2).alias("weight")))
    return nodes, edges, rows, labels


@query(f"""WITH {_JOURNAL} SELECT 'e:' || k || ':' || e || '->' || nid AS id, round(greatest(0.3, 0.3 + 0.5 * importance), 6) AS weight FROM ends UNION ALL SELECT 'c:' || id, 0.2 FROM left_""")
def heartbeat_mentions(spark, d):
    return G.heartbeat_graph(*_journal(spark, d), most=20)[1].select("id", r6("weight").alias("weight"))


@query(f"""WITH {_JOURNAL}, n AS (SELECT nid AS id, (CASE WHEN k = 'fact' THEN 'Heartbeat finding: ' ELSE 'Heartbeat action: ' END) || trim(summary) AS text, l.doc_id + 1 AS recalls, true AS scoped FROM own LEFT JOIN left_ l ON l.id = nid
        UNION ALL SELECT id, NULL, NULL, id IN (SELECT e FROM ends) FROM (SELECT DISTINCT node AS id FROM lab UNION SELECT 'self')) SELECT id, text, recalls, scoped FROM n""")
def heartbeat_nodes(spark, d):
    return G.heartbeat_graph(*_journal(spark, d), most=20)[0].select("id", "text", F.col("recall_count").alias("recalls"), F.col("character_scoped").alias("scoped"))


_FACTS = """fr AS (SELECT event_id AS id, CASE WHEN event_id % 4 = 0 THEN '' ELSE 'u' || (user_id % 50) END AS user_id, CASE WHEN event_id % 23 = 0 THEN '  ' ELSE props END AS content, (event_id % 11) / 10.0::DOUBLE AS importance FROM events), fs AS (SELECT id, 'person:s' || (id % 40) AS subject FROM fr WHERE id % 3 = 0),
    fe AS (SELECT id, 'entity:e' || (id % 30) AS entity FROM fr WHERE id % 2 = 0 UNION ALL SELECT id, 'entity:e' || (id % 7) FROM fr), ok AS (SELECT fr.id, 'fact:' || fr.id AS fact, coalesce(subject, CASE WHEN user_id <> '' THEN 'person:' || user_id ELSE 'self' END) AS subject, nullif(user_id, '') AS owner, importance FROM fr LEFT JOIN fs ON fs.id = fr.id WHERE trim(content) <> ''),
    nm AS (SELECT DISTINCT fact, entity, owner, subject FROM fe JOIN ok ON ok.id = fe.id)"""


def _ingested(spark, d):
    k = F.col("event_id")
    text = lambda letter, n: F.concat(F.lit(letter), n.cast("string"))
    facts = table(spark, d, "events").select(k.alias("id"), F.when(k % 4 == 0, "").otherwise(text("u", F.col("user_id") % 50)).alias("user_id"), F.when(k % 23 == 0, "  ").otherwise(F.col("props")).alias("content"), (k % 11 / 10).alias("importance"), F.lit(0.5).alias("confidence"), F.lit(None).cast("string").alias("chat_id"))
    k = F.col("id")
    entity = lambda df, n: df.select("id", text("E", n).alias("name"), text("entity:e", n).alias("entity"), F.lit("thing").alias("kind_label"))
    return M.ingested_facts(facts, facts.where("id % 3 = 0").select("id", text("person:s", k % 40).alias("subject")), entity(facts.where("id % 2 = 0"), k % 30).unionByName(entity(facts, k % 7)))


@query(f"""WITH {_FACTS}, n AS (SELECT fact AS id, owner, subject = 'self' AS own FROM ok UNION ALL SELECT subject, owner, subject = 'self' FROM ok UNION ALL SELECT entity, owner, subject = 'self' FROM nm) SELECT id, array_to_string(list_sort(coalesce(list(DISTINCT owner) FILTER (owner IS NOT NULL), [])), ',') AS owners, bool_or(own) AS scoped FROM n GROUP BY id""")
def ingested_nodes(spark, d):
    return _ingested(spark, d)[0].select("id", F.array_join("owners", ",").alias("owners"), F.col("character_scoped").alias("scoped"))


@query(f"WITH {_FACTS} SELECT 'e:fact:' || subject || '->' || fact AS id, round(greatest(0.3, least(1, 0.3 + 0.7 * least(1, importance))), 6) AS weight FROM ok UNION ALL SELECT 'e:fact:' || entity || '->' || fact, 0.4 FROM nm")
def ingested_edges(spark, d):
    return _ingested(spark, d)[1].select("id", r6("weight").alias("weight"))


_WIKI = """wn AS (SELECT 'd' || doc_id AS id, ['person', 'fact', 'entity', 'episode'][doc_id % 4 + 1] AS kind, CASE WHEN doc_id % 3 = 0 THEN 'wiki:' || doc_id WHEN doc_id % 3 = 1 THEN 'row:1' ELSE '' END AS source, doc_id % 5 < 2 AS ref, doc_id % 10 = 1 AS more, doc_id % 7 = 0 AS owned, doc_id FROM documents),
    wl AS (SELECT * FROM wn WHERE NOT (kind IN ('fact', 'episode') AND starts_with(source, 'wiki:')) AND NOT (kind IN ('person', 'entity') AND ref AND NOT more AND NOT owned AND source = '')),
    we AS (SELECT 'e' || doc_id AS id, 'd' || doc_id AS src, 'd' || (doc_id // 2) AS dst, CASE WHEN doc_id % 2 = 0 THEN 'relation' ELSE 'fact' END AS kind, CASE WHEN doc_id % 6 = 0 THEN 'wiki' END AS provenance FROM documents)"""


@query(f"""WITH {_WIKI} SELECT id, CASE WHEN NOT ref THEN '' WHEN kind IN ('person', 'entity') THEN CASE WHEN more THEN 'x:1' ELSE '' END WHEN more THEN 'wiki:a,x:1' ELSE 'wiki:a' END AS refs FROM wl
    UNION ALL SELECT id, src FROM we WHERE NOT (kind = 'relation' AND provenance IS NOT DISTINCT FROM 'wiki') AND src IN (SELECT id FROM wl) AND dst IN (SELECT id FROM wl)""")
def wiki_dropped(spark, d):
    k, docs = F.col("doc_id"), table(spark, d, "documents")
    refs = F.when(k % 10 == 1, F.array(F.lit("wiki:a"), F.lit("x:1"))).when(k % 5 < 2, F.array(F.lit("wiki:a"))).otherwise(F.array().cast("array<string>"))
    nodes = docs.select(_name("d", "doc_id").alias("id"), F.get(F.array(*map(F.lit, ["person", "fact", "entity", "episode"])), (k % 4).cast("int")).alias("kind"), F.when(k % 3 == 0, _name("wiki:", "doc_id")).when(k % 3 == 1, "row:1").otherwise("").alias("source"), refs.alias("external_refs"), F.when(k % 7 == 0, F.array(F.lit("u"))).alias("owners"))
    edges = docs.select(_name("e", "doc_id").alias("id"), F.when(k % 2 == 0, "relation").otherwise("fact").alias("kind"), _name("d", "doc_id").alias("src"), F.concat(F.lit("d"), F.expr("doc_id div 2").cast("string")).alias("dst"), F.lit(0.5).alias("weight"), F.when(k % 6 == 0, "wiki").alias("provenance"))
    left, kept = G.without_wiki(nodes, edges)
    return left.select("id", F.array_join("external_refs", ",").alias("refs")).unionByName(kept.select("id", F.col("src").alias("refs")))
