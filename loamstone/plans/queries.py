"""Registered queries over the standard tables, each with DuckDB SQL where SQL can express it.

Conversations are messages, events are remembered rows (facts or episodes), documents and benchmark items are corpus and queries,
embeddings are vectors, and customers, orders, lines and parts make the graph. The query time is fixed, so results are deterministic.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chunking, temporal
from ..functions import scoring as S
from ..functions import text as T
from ..operators import calendar as C
from ..operators import conversation as V
from ..operators import dedup as E
from ..operators import graph as G
from ..operators import memory as M
from ..operators import recall as R
from ..operators import retrieval as X
from ..operators import tables as B
from ..operators import vectors as N
from ..session import over_cores
from ..streaming import ingest as I

NOW = 1_706_745_600.0  # 2024-02-01 UTC
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_MSG = "messages AS (SELECT conv_id AS chat_id, conv_id * 1000 + turn AS id, role, text AS content FROM conversations)"
_ROWS = "rows_ AS (SELECT event_id AS id, user_id, least(1.0::DOUBLE, value / 100) AS importance, epoch(ts)::DOUBLE AS created_at, event_id % 20 AS recall_count, event_type AS type, props AS content FROM events)"
_TOK = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}_]+'), lambda x: x <> '')"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return over_cores(found) if name == "documents" else found  # whole texts are work for each row


def messages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select(F.col("conv_id").alias("chat_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "role", F.col("text").alias("content"))


def remembered(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        F.col("event_id").alias("id"), "user_id", F.least(F.lit(1.0), F.col("value") / 100).alias("importance"), T.epoch(F.col("ts")).alias("created_at"),
        (F.col("event_id") % 20).alias("recall_count"), F.col("event_type").alias("type"), F.col("props").alias("content"),
    )


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# ---- tables


@query(f"WITH {_ROWS} SELECT id, user_id, type FROM rows_ WHERE type = 'click' AND user_id = 7")
def scan_equal(spark, d):
    return B.scan(remembered(spark, d), {"type": "click", "user_id": 7}).select("id", "user_id", "type")


@query(f"WITH {_ROWS} SELECT id, user_id FROM rows_ ORDER BY id DESC LIMIT 25 OFFSET 25")
def page_newest(spark, d):
    return B.page(remembered(spark, d), 2, 25).select("id", "user_id")


@query(f"WITH {_ROWS} SELECT user_id, count(*) AS n FROM rows_ WHERE created_at >= 1704672000 AND created_at < 1705276800 GROUP BY user_id")
def count_created_range(spark, d):
    return B.in_range(remembered(spark, d), "created_at", 1704672000.0, 1705276800.0).groupBy("user_id").agg(F.count("*").alias("n"))


@query(f"WITH {_ROWS} SELECT DISTINCT user_id FROM rows_")
def distinct_users(spark, d):
    return B.distinct_users(remembered(spark, d))


@query(f"""WITH {_ROWS}, new AS (SELECT id + 5 AS id, 'changed' AS type FROM rows_ WHERE id % 10 = 0)
    SELECT coalesce(r.id, n.id) AS id, coalesce(n.type, r.type) AS type, r.user_id FROM rows_ r FULL JOIN new n ON r.id = n.id""")
def upsert_rows(spark, d):
    rows = remembered(spark, d).select("id", "type", "user_id")
    return B.upsert(rows, rows.where("id % 10 = 0").select((F.col("id") + 5).alias("id"), F.lit("changed").alias("type")))


@query(f"WITH {_ROWS} SELECT id FROM rows_ WHERE type <> 'click'")
def delete_filtered(spark, d):
    return B.delete_where(remembered(spark, d), type="click").select("id")


@query(f"WITH {_ROWS} SELECT id, user_id FROM rows_ QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY id DESC) <= 3")
def retention_newest(spark, d):
    return B.newest(remembered(spark, d), 3, per=["user_id"]).select("id", "user_id")


@query("""WITH old AS (SELECT doc_id % 300 AS id, text, source FROM documents), new AS (SELECT doc_id % 301 AS id, text, source FROM documents WHERE doc_id % 7 <> 0),
    a AS (SELECT id, list_sort(list({'t': text, 's': source})) AS x FROM old GROUP BY id), b AS (SELECT id, list_sort(list({'t': text, 's': source})) AS y FROM new GROUP BY id)
    SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'delete' WHEN a.id IS NULL THEN 'add' ELSE 'replace' END AS action FROM a FULL JOIN b ON a.id = b.id WHERE a.x IS DISTINCT FROM b.y""")
def index_delta(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "source")
    return B.index_delta(docs.withColumn("id", F.col("doc_id") % 300), docs.where("doc_id % 7 <> 0").withColumn("id", F.col("doc_id") % 301))


@query("""WITH a AS (SELECT doc_id, text, lang FROM documents WHERE doc_id % 5 <> 0), b AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN upper(text) ELSE text END AS text, lang FROM documents WHERE doc_id % 4 <> 0)
    SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'removed' ELSE 'changed' END AS change
    FROM a FULL JOIN b ON a.doc_id = b.doc_id WHERE a.text IS DISTINCT FROM b.text OR a.lang IS DISTINCT FROM b.lang""")
def row_changes(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    after = docs.where("doc_id % 4 <> 0").withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.upper("text")).otherwise(F.col("text")))
    return B.changed_rows(docs.where("doc_id % 5 <> 0"), after, "doc_id")


@query("SELECT event_type, count(*) FILTER (user_id % 3 = 0) AS created, count(*) FILTER (user_id % 3 = 1) AS updated, count(*) FILTER (user_id % 3 = 2) AS skipped, count(*) AS total FROM events GROUP BY event_type")
def report_tallies(spark, d):
    status = F.element_at(F.array(F.lit("created"), F.lit("updated"), F.lit("skipped")), (F.col("user_id") % 3 + 1).cast("int"))
    return B.tallies(table(spark, d, "events").withColumn("status", status), "event_type", "status", ["created", "updated", "skipped"])


@query("""WITH i AS (SELECT user_id, epoch(ts)::DOUBLE AS s, epoch(ts)::DOUBLE + 3600 AS e FROM events),
    m AS (SELECT *, CASE WHEN max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= s THEN 0 ELSE 1 END AS f FROM i),
    n AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM m)
    SELECT user_id, min(s) AS start, max(e) AS "end" FROM n GROUP BY user_id, g""")
def interval_union(spark, d):
    e = T.epoch(F.col("ts"))
    return B.interval_union(table(spark, d, "events").select("user_id", e.alias("start"), (e + 3600).alias("end")), per=["user_id"])


@query("""WITH v AS (SELECT doc_id, list_distinct([source, lang]) AS disclosed, lang = 'en' AS pub FROM documents)
    SELECT doc_id FROM v WHERE pub OR list_has_all(disclosed, ['fr'])""")
def audience_subset(spark, d):
    docs = table(spark, d, "documents").withColumn("disclosed", F.array("source", "lang"))
    return docs.where(B.audience("disclosed", F.col("lang") == "en", ["fr"])).select("doc_id")


# ---- retrieval

_BM25 = rf"""q AS (SELECT item_id AS query_id, list_distinct({_TOK}) AS terms FROM benchmark WHERE item_id % 20 = 0),
    d AS (SELECT doc_id AS id, {_TOK} AS w FROM documents WHERE {{where}}), st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM d),
    p AS (SELECT id, term, len(w) AS length, count(*) AS tf FROM (SELECT id, w, unnest(w) AS term FROM d) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
    s AS (SELECT query_id, p.id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / avgdl))) AS score
          FROM (SELECT query_id, unnest(terms) AS term FROM q) t JOIN p USING (term) JOIN df USING (term), st GROUP BY ALL)"""


def _bm25_sql(where: str) -> str:
    return _BM25.replace("{where}", where)


def _asked(spark, d) -> DataFrame:
    """The query set of a search: every item whose id is divisible by 20."""
    return table(spark, d, "benchmark").where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), F.lit(0).alias("sub_ix"), "text", F.lit(1.0).alias("weight"))


def _bm25(docs: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    scores = X.bm25_top(X.indexed(docs, queries=asked), asked, k)
    return X.ranked(scores.withColumn("score", r6("score")), k).select("query_id", "id", "score", "rank")


@query(f"WITH {_bm25_sql('true')} SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) - 1 AS rank FROM s QUALIFY rank < 10")
def bm25_topk(spark, d):
    return _bm25(table(spark, d, "documents"), _asked(spark, d), 10)


@query(f"WITH {_bm25_sql("lang = 'de'")} SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) - 1 AS rank FROM s QUALIFY rank < 10")
def bm25_scoped_topk(spark, d):
    return _bm25(table(spark, d, "documents").where("lang = 'de'"), _asked(spark, d), 10)


_DENSE = """q AS (SELECT vec_id AS query_id, embedding AS u FROM embeddings WHERE vec_id % 20 = 0),
    s AS (SELECT query_id, vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], u::DOUBLE[]), 6) AS score FROM embeddings, q WHERE {where})"""


def _vectors(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.lit(0).alias("sub_ix"), F.col("embedding").alias("vec"))


@query(f"WITH {_DENSE.format(where='true')} SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank FROM s QUALIFY rank < 10")
def dense_topk(spark, d):
    near = X.dense(table(spark, d, "embeddings"), _vectors(spark, d), pool=10).withColumn("score", r6("score"))
    return X.ranked(near, 10).select("query_id", "id", "score", "rank")


@query(f"WITH {_DENSE.format(where='label < 3')} SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank FROM s WHERE score > 0.2 QUALIFY rank < 10")
def dense_floor_filtered(spark, d):
    near = X.dense(table(spark, d, "embeddings").where("label < 3"), _vectors(spark, d), floor=0.2 - 1e-6, pool=10).withColumn("score", r6("score"))
    return X.ranked(near.where("score > 0.2"), 10).select("query_id", "id", "score", "rank")


def _near(spark, d, **how) -> DataFrame:
    near = N.nearest(N.inverted(table(spark, d, "embeddings")), _vectors(spark, d), 10, **how)
    return X.ranked(near.withColumn("score", r6("score")), 10).select("query_id", "id", "score", "rank")


@query(f"WITH {_DENSE.format(where='true')} SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank FROM s QUALIFY rank < 10")
def lists_topk_all_probed(spark, d):
    return _near(spark, d, probes=1 << 30)


@query(f"WITH {_DENSE.format(where='label = 3 AND vec_id % 10 = 3')} SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank FROM s QUALIFY rank < 10")
def lists_topk_completed(spark, d):
    return _near(spark, d, probes=1, where=(F.col("label") == 3) & (F.col("vec_id") % 10 == 3), exact=True)


@query()
def lists_topk(spark, d):
    return _near(spark, d)


@query(f"""WITH {_bm25_sql('true')}, lx AS (SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) - 1 AS rank FROM s QUALIFY rank < 30),
    v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings), dn AS (SELECT a.id AS query_id, b.id, round(list_cosine_similarity(a.e, b.e), 6) AS score FROM v a, v b WHERE a.id IN (SELECT query_id FROM q)),
    dr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank FROM dn QUALIFY rank < 30),
    h AS (SELECT query_id, id, 1.0::DOUBLE / (61 + rank) AS rrf, greatest(0, least(1, score / max(score) OVER (PARTITION BY query_id))) AS c FROM lx UNION ALL SELECT query_id, id, 1.0::DOUBLE / (61 + rank), greatest(0, least(1, score)) FROM dr),
    f AS (SELECT query_id, id, sum(rrf) AS score, 1 - product(1 - c) AS confidence FROM h GROUP BY ALL)
    SELECT query_id, id, round(score, 6) AS score, round(confidence, 6) AS confidence, round(least(1, score / (2.0::DOUBLE / 61)), 6) AS relevance, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) AS rank FROM f QUALIFY rank <= 10""")
def rrf_hybrid(spark, d):
    docs, asked = table(spark, d, "documents"), _asked(spark, d)
    lexical = X.ranked(X.bm25_top(X.indexed(docs, queries=asked), asked, X.POOL).withColumn("score", r6("score")))
    own = table(spark, d, "embeddings")
    vectors = own.join(asked.select(F.col("query_id").alias("vec_id")), "vec_id", "left_semi").select(F.col("vec_id").alias("query_id"), F.lit(0).alias("sub_ix"), F.col("embedding").alias("vec"))
    near = X.ranked(X.dense(own, vectors, pool=X.POOL).withColumn("score", r6("score")))
    out = X.fused(lexical, near, asked)
    out = out.select("query_id", "id", r6("score").alias("score"), r6("confidence").alias("confidence"), r6("relevance").alias("relevance"))
    return X.top(out, 10)


@query(f"""WITH {_MSG}, u AS (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY id DESC) AS n, first(content) OVER (PARTITION BY chat_id ORDER BY id DESC) AS cur FROM messages WHERE role = 'user' QUALIFY n <= 5),
    k AS (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY id DESC) - 1 AS ix FROM u WHERE n = 1 OR trim(content) <> trim(cur))
    SELECT chat_id, ix AS sub_ix, content AS text, round(pow(0.6, ix), 6) AS weight FROM k WHERE trim(content) <> ''""")
def history_weights(spark, d):
    turns = messages(spark, d).where("role = 'user'").select("chat_id", "id", F.col("content").alias("text"))
    return X.history_queries(turns).withColumn("weight", r6("weight"))


@query("SELECT doc_id, ((length(lower(text)) - length(replace(lower(text), 'the', ''))) / 3)::BIGINT AS score FROM documents WHERE contains(lower(text), 'the')")
def substring_rank(spark, d):
    return X.substring_ranked(table(spark, d, "documents"), "the").select("doc_id", "score")


@query(f"""WITH {_DENSE.format(where="true")}, h AS (SELECT s.*, label AS result_id FROM s JOIN embeddings ON vec_id = id), b AS (SELECT *, row_number() OVER (PARTITION BY query_id, result_id ORDER BY score DESC, id) AS r FROM h QUALIFY r = 1)
    SELECT query_id, id, result_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank FROM b QUALIFY rank < 5""")
def result_groups(spark, d):
    own = table(spark, d, "embeddings")
    hits = X.dense(own, _vectors(spark, d), pool=5, result_col="label").withColumn("score", r6("score")).join(own.select(F.col("vec_id").alias("id"), "label"), "id")
    return X.ranked(hits, 5, F.col("label")).select("query_id", "id", "result_id", "rank")


# ---- recall

_DECAY = "least(importance, importance * exp(-greatest(0, 1706745600 - created_at) / 259200) + 0.1::DOUBLE * importance * (recall_count / (recall_count + 10.0::DOUBLE)))"


@query(f"WITH {_ROWS} SELECT id, round(recall_count / (recall_count + 10.0::DOUBLE), 6) AS familiarity, round({_DECAY}, 6) AS score FROM rows_")
def decay_scores(spark, d):
    score = S.decay_score(F.col("importance"), F.col("recall_count"), S.age_seconds(NOW, F.col("created_at")), R.E_FOLD)
    return remembered(spark, d).select("id", r6(S.exposure_saturation(F.col("recall_count"))).alias("familiarity"), r6(score).alias("score"))


@query(f"WITH {_ROWS}, s AS (SELECT *, {_DECAY} AS f FROM rows_) SELECT id, round(f + (id % 11) / 10.0::DOUBLE * 1.1::DOUBLE * greatest(0, importance - f), 6) AS score FROM s WHERE id % 11 <= 10")
def repair_scores(spark, d):
    familiar = S.decay_score(F.col("importance"), F.col("recall_count"), S.age_seconds(NOW, F.col("created_at")), R.E_FOLD)
    return remembered(spark, d).select("id", r6(S.repaired_score(F.col("importance"), familiar, F.col("id") % 11 / 10.0)).alias("score"))


_RECALL = f"""{_ROWS}, sem AS (SELECT id, (id % 13) / 12.0::DOUBLE AS semantic FROM rows_ WHERE id % 3 = 0), tmp AS (SELECT id, 0.9::DOUBLE AS temporal FROM rows_ WHERE created_at >= 1705276800 AND created_at < 1705363200),
    c AS (SELECT r.*, coalesce(semantic, 0) AS semantic, coalesce(temporal, 0) AS temporal, importance >= 0.95 AS is_sticky FROM rows_ r LEFT JOIN sem USING (id) LEFT JOIN tmp USING (id) WHERE semantic IS NOT NULL OR temporal IS NOT NULL OR importance >= 0.95),
    e AS (SELECT *, {_DECAY} AS effective, 1 - (1 - semantic) * (1 - temporal) AS combined FROM c),
    s AS (SELECT *, round(effective + combined * 1.1::DOUBLE * greatest(0, importance - effective), 6) AS score FROM e)"""


def _candidates(spark, d) -> DataFrame:
    rows = remembered(spark, d)
    semantic = rows.where("id % 3 = 0").select("id", (F.col("id") % 13 / 12.0).alias("semantic"))
    ranges = spark.createDataFrame([(1705276800.0, 1705363200.0, 0.9, 1.0)], "start double, end double, confidence double, query_weight double")
    matched = R.temporal_relevance(rows.withColumnRenamed("created_at", "occurred_at"), ranges)
    return R.scored(rows, semantic, matched, NOW).withColumn("score", r6("score"))


@query(f"""WITH {_RECALL}, o AS (SELECT *, max(is_sticky) OVER (PARTITION BY user_id) AS any_ FROM s),
    n AS (SELECT *, row_number() OVER (PARTITION BY user_id, any_ AND is_sticky ORDER BY score DESC, combined DESC, temporal DESC, semantic DESC, CASE WHEN any_ AND is_sticky THEN effective ELSE 0 END DESC, id) AS r FROM o),
    k AS (SELECT * FROM n WHERE CASE WHEN NOT any_ THEN r <= 5 WHEN is_sticky THEN r = 1 ELSE r <= 4 END)
    SELECT user_id, id, is_sticky, score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, combined DESC, temporal DESC, semantic DESC, id) AS rank FROM k""")
def recall_sticky_topk(spark, d):
    return R.sticky_top(_candidates(spark, d), 5, ["user_id"]).select("user_id", "id", "is_sticky", "score", "rank")


@query(f"""WITH {_ROWS}, t AS (SELECT o_orderkey % 40 AS query_id, 1704067200.0 + (o_orderkey * 7919) % 2592000 AS s, 1704067200.0 + (o_orderkey * 7919) % 2592000 + pow(2, o_orderkey % 8)::BIGINT * 60 AS e, 0.5 + (o_orderkey % 5) / 10.0::DOUBLE AS worth FROM orders),
    r AS (SELECT id, created_at AS a, CASE WHEN id % 3 > 0 THEN created_at + (id % 50) * 60 END AS z FROM rows_)
    SELECT query_id, id, round(max(worth), 6) AS temporal FROM r JOIN t ON CASE WHEN z IS NULL THEN s <= a AND a < e ELSE a < e AND z > s END GROUP BY ALL""")
def temporal_matches(spark, d):
    k = F.col("o_orderkey")
    start = 1704067200.0 + k * 7919 % 2592000
    ranges = table(spark, d, "orders").select((k % 40).alias("query_id"), start.alias("start"), (start + F.pow(F.lit(2), k % 8) * 60).alias("end"), (0.5 + k % 5 / 10.0).alias("confidence"), F.lit(1.0).alias("query_weight"))
    rows = remembered(spark, d).withColumn("until", F.when(F.col("id") % 3 > 0, F.col("created_at") + F.col("id") % 50 * 60))
    return R.temporal_relevance(rows, ranges, "created_at", "until", per=["query_id"]).select("query_id", "id", r6("temporal").alias("temporal"))


@query(f"WITH {_RECALL} SELECT id, round(combined, 6) AS combined, round(effective, 6) AS effective, score FROM s")
def recall_scores(spark, d):
    return _candidates(spark, d).select("id", r6("combined").alias("combined"), r6("effective").alias("effective"), "score")


@query("SELECT doc_id, CASE WHEN len(list_filter([lang, source], lambda k: contains('tell me about src7 and en things', lower(k)))) > 0 THEN 1.0 ELSE 0.0 END AS relevance FROM documents")
def keyword_relevance(spark, d):
    return table(spark, d, "documents").select("doc_id", R.keyword_relevance("Tell me about src7 and EN things", F.array("lang", "source")).alias("relevance"))


@query(f"WITH {_ROWS} SELECT id, CASE WHEN created_at <= 1705276800 AND created_at + recall_count * 3600 <= 1705276800 - 86400 THEN 0.7 ELSE 0.0 END AS relevance FROM rows_")
def followup_due(spark, d):
    return remembered(spark, d).select("id", R.followup_relevance(F.col("created_at"), F.col("created_at") + F.col("recall_count") * 3600, 1705276800.0).alias("relevance"))


@query(f"WITH {_ROWS}, t AS (SELECT id, user_id, 10 + id % 30 AS tokens, round(importance, 6) AS score FROM rows_), u AS (SELECT *, sum(tokens) OVER (PARTITION BY user_id ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING)::BIGINT AS used_tokens FROM t) SELECT id, user_id, used_tokens FROM u WHERE used_tokens <= 200")
def token_budget_prefix(spark, d):
    items = remembered(spark, d).select("id", "user_id", (10 + F.col("id") % 30).alias("tokens"), r6("importance").alias("score"))
    return R.budget_prefix(items, 200, [F.desc("score"), F.asc("id")], per=["user_id"]).select("id", "user_id", "used_tokens")


@query(f"""WITH RECURSIVE {_ROWS}, t AS (SELECT id, user_id, 10 + id % 30 AS tokens, round(1 - importance, 6) AS "order" FROM rows_), o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY "order", id) AS n FROM t),
    s AS (SELECT user_id, 0::BIGINT AS n, 0::BIGINT AS used, NULL::BIGINT AS id FROM (SELECT DISTINCT user_id FROM t)
          UNION ALL SELECT s.user_id, o.n, s.used + CASE WHEN s.used + o.tokens <= 200 THEN o.tokens ELSE 0 END, CASE WHEN s.used + o.tokens <= 200 THEN o.id END FROM s JOIN o ON o.user_id = s.user_id AND o.n = s.n + 1)
    SELECT o.id, o.user_id, tokens, "order" FROM s JOIN o ON o.id = s.id""")
def token_budget_greedy(spark, d):
    items = remembered(spark, d).select("id", "user_id", (10 + F.col("id") % 30).alias("tokens"), r6(1 - F.col("importance")).alias("order"))
    return R.budget_greedy(items, 200, "user_id", ["order", "id"])


# items with their length in the prompt: the title of their section, the name that they stand under, their line
_ITEMS = f"""{_ROWS}, t AS (SELECT id, user_id, type AS section, CASE WHEN id % 3 > 0 THEN 'person ' || (id % 2) END AS under, CASE WHEN id % 19 = 0 THEN ' ' ELSE content END AS text, round(1 - importance, 6) AS rank FROM rows_),
    o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rank, id) AS n FROM t WHERE trim(text) <> ''),
    s AS (SELECT user_id, 0::BIGINT AS n, []::VARCHAR[] AS heads, 0::BIGINT AS used, NULL::BIGINT AS id FROM (SELECT DISTINCT user_id FROM t)
          UNION ALL SELECT s.user_id, o.n, CASE WHEN fits THEN list_distinct(list_concat(heads, CASE WHEN under IS NULL THEN [section] ELSE [section, section || '/' || under] END)) ELSE heads END, CASE WHEN fits THEN whole ELSE used END, CASE WHEN fits THEN o.id END
          FROM s JOIN o ON o.user_id = s.user_id AND o.n = s.n + 1, LATERAL (SELECT used + length(trim(text)) + 3 + CASE WHEN list_contains(heads, section) THEN 0 ELSE length('About ' || section) + 3 + CASE WHEN len(heads) > 0 THEN 2 ELSE 0 END END
              + CASE WHEN under IS NULL OR list_contains(heads, section || '/' || under) THEN 0 ELSE length(under) + 2 END AS whole), LATERAL (SELECT ceil(whole / 4.0) <= 90 AS fits))"""


def _items(spark, d) -> tuple[DataFrame, dict]:
    k = F.col("id")
    items = remembered(spark, d).select("id", "user_id", F.col("type").alias("section"), F.when(k % 3 > 0, F.concat(F.lit("person "), (k % 2).cast("string"))).alias("under"), F.when(k % 19 == 0, " ").otherwise(F.col("content")).alias("text"), r6(1 - F.col("importance")).alias("rank"))
    titles = {x: f"About {x}" for x in ("view", "click", "purchase", "signup", "error", "login", "logout", "search", "refund", "add_to_cart")}
    return R.budget_rendered(items, 90, ["rank", "id"], "user_id", titles=titles, under="under"), titles


@query(f"WITH RECURSIVE {_ITEMS} SELECT id, user_id, ceil(used / 4.0)::BIGINT AS used_tokens FROM s WHERE id IS NOT NULL")
def budget_rendered(spark, d):
    return _items(spark, d)[0].select("id", "user_id", "used_tokens")


@query(f"WITH RECURSIVE {_ITEMS}, c AS (SELECT user_id, max(used) AS length FROM s GROUP BY user_id) SELECT user_id, length FROM c WHERE length > 0")
def rendered_prompts(spark, d):
    items, titles = _items(spark, d)
    return R.rendered(items, ["rank", "id"], "user_id", titles=titles, under="under").select("user_id", F.length("prompt").cast("long").alias("length"))


@query(f"WITH {_ROWS}, b AS (SELECT user_id, type AS memory, id, importance / max(importance) OVER (PARTITION BY user_id, type) * CASE WHEN type = 'click' THEN 0.5 ELSE 1 END AS s FROM rows_) SELECT user_id, memory, id, round(s, 6) AS reranked, row_number() OVER (PARTITION BY user_id ORDER BY s DESC, id) AS position FROM b")
def score_reranker(spark, d):
    items = remembered(spark, d).select("user_id", F.col("type").alias("memory"), "id", F.col("importance").alias("score"), F.col("id").alias("input_pos"))
    return R.reranked(items, {"click": 0.5}, per=["user_id"]).select("user_id", "memory", "id", r6("reranked").alias("reranked"), "position")


@query("SELECT event_id, round((value - min(value) OVER (PARTITION BY user_id)) / CASE WHEN max(value) OVER (PARTITION BY user_id) > min(value) OVER (PARTITION BY user_id) THEN max(value) OVER (PARTITION BY user_id) - min(value) OVER (PARTITION BY user_id) ELSE 1 END, 6) AS x FROM events")
def min_max_norm(spark, d):
    return R.min_max(table(spark, d, "events"), "value", "x", ["user_id"]).select("event_id", r6("x").alias("x"))


@query(f"""WITH {_ROWS} SELECT id, CASE WHEN a < 60 THEN 'just now' WHEN a < 3600 THEN (a // 60) || CASE WHEN a // 60 = 1 THEN ' minute ago' ELSE ' minutes ago' END WHEN a < 86400 THEN (a // 3600) || CASE WHEN a // 3600 = 1 THEN ' hour ago' ELSE ' hours ago' END
    WHEN a < 604800 THEN (a // 86400) || CASE WHEN a // 86400 = 1 THEN ' day ago' ELSE ' days ago' END WHEN a // 604800 < 5 THEN (a // 604800) || CASE WHEN a // 604800 = 1 THEN ' week ago' ELSE ' weeks ago' END ELSE 'long' END AS label
    FROM (SELECT id, floor(1706745600 - created_at)::BIGINT AS a FROM rows_)""")
def relative_age(spark, d):
    return remembered(spark, d).select("id", T.age_label(F.lit(NOW) - F.col("created_at")).alias("label"))


# ---- conversations


@query(f"""WITH m AS (SELECT conv_id AS chat_id, conv_id * 1000 + turn AS id, role, text AS content, CASE WHEN turn % 3 > 0 AND conv_id % 2 = 0 THEN 'User: ' || (turn % 4) || '!' END AS user_id FROM conversations), w AS (SELECT *, coalesce(user_id, 'owner ' || chat_id) AS who FROM m),
    p AS (SELECT chat_id, count(DISTINCT who) FILTER (role = 'user' AND user_id IS NOT NULL) > 0 AS many FROM w GROUP BY chat_id)
    SELECT chat_id, id, role, content, CASE WHEN many AND role = 'user' THEN regexp_replace(regexp_replace(who, '[^a-zA-Z0-9_-]+', '', 'g'), '^[_-]+|[_-]+$', '', 'g') END AS name FROM w JOIN p USING (chat_id)""")
def named_messages(spark, d):
    turn, chat = F.col("turn"), F.col("conv_id")
    rows = table(spark, d, "conversations").select(chat.alias("chat_id"), (chat * 1000 + turn).alias("id"), "role", F.col("text").alias("content"), F.when((turn % 3 > 0) & (chat % 2 == 0), F.concat(F.lit("User: "), (turn % 4).cast("string"), F.lit("!"))).alias("user_id"))
    owners = rows.select("chat_id").distinct().withColumn("owner", F.concat(F.lit("owner "), F.col("chat_id").cast("string")))
    return V.named_messages(rows, owners)


@query(f"""WITH {_MSG}, r AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY chat_id ORDER BY id ROWS UNBOUNDED PRECEDING)::BIGINT AS round FROM messages)
    SELECT chat_id, round, min(id) AS first_id, max(id) AS last_id, count(*) AS messages, string_agg(content, chr(10) ORDER BY id) AS content FROM r GROUP BY ALL""")
def conversation_rounds(spark, d):
    return V.rounds(messages(spark, d)).drop("occurred_at")


@query(f"WITH {_MSG}, n AS (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY id) AS n FROM messages) SELECT n.chat_id, n.id, n.n - o.n AS distance FROM n JOIN n o ON o.id = 7003 AND n.chat_id = o.chat_id WHERE abs(n.n - o.n) BETWEEN 1 AND 2")
def event_neighbours(spark, d):
    return V.neighbours(messages(spark, d), 7003, order="id", key="id").select("chat_id", "id", "distance")


@query(f"WITH {_MSG}, m AS (SELECT *, id % 1000 < 3 AS extracted FROM messages), l AS (SELECT *, coalesce(max(CASE WHEN extracted THEN id END) OVER (PARTITION BY chat_id), -1) AS last FROM m) SELECT chat_id, count(*) FILTER (role = 'user' AND NOT extracted AND id > last) AS turns FROM l GROUP BY chat_id")
def turns_since_extraction(spark, d):
    return V.turns_since_extraction(messages(spark, d).withColumn("extracted", F.col("id") % 1000 < 3))


@query(f"""WITH {_MSG}, u AS (SELECT chat_id, coalesce(CASE WHEN id % 3 > 0 THEN 'u' || (id % 3) END, 'owner') AS user_id, min(id) AS f FROM messages WHERE role = 'user' GROUP BY ALL),
    a AS (SELECT * FROM u UNION ALL SELECT DISTINCT chat_id, 'owner', -1 FROM messages WHERE chat_id NOT IN (SELECT chat_id FROM u WHERE user_id = 'owner'))
    SELECT chat_id, user_id, row_number() OVER (PARTITION BY chat_id ORDER BY f) AS position FROM a""")
def participants_first_seen(spark, d):
    named = messages(spark, d).withColumn("user_id", F.when(F.col("id") % 3 > 0, F.concat(F.lit("u"), (F.col("id") % 3).cast("string"))))
    return V.participants(named, "owner")


@query(f"WITH {_MSG} SELECT chat_id, arg_max(content, id) AS content, max(id) AS id FROM messages WHERE role = 'user' GROUP BY chat_id")
def last_user_message(spark, d):
    return V.last_user_message(messages(spark, d))


@query("""WITH e AS (SELECT event_id, unnest([event_id, event_id // 2]) AS m FROM events), f AS (SELECT doc_id AS fact_id, unnest([doc_id, doc_id * 3]) AS m FROM documents)
    SELECT DISTINCT event_id, fact_id FROM e JOIN f USING (m)""")
def provenance_overlap(spark, d):
    events = table(spark, d, "events").select("event_id", F.expr("array(event_id, event_id div 2)").alias("source_message_ids"))
    facts = table(spark, d, "documents").select(F.col("doc_id").alias("fact_id"), F.array(F.col("doc_id"), F.col("doc_id") * 3).alias("source_message_ids"))
    return V.provenance_links(events, facts)


@query("""WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n FROM conversations), w AS (SELECT *, unnest(range(greatest(0, ceil((n - 2) / 3)::BIGINT), (n + 1) // 3 + 1)) AS win FROM t),
    o AS (SELECT *, n >= win * 3 AS own FROM w)
    SELECT conv_id, win AS "window", list_sort(list_distinct(list(role) FILTER (own))) AS speakers,
           CASE WHEN bool_and(own) THEN '' ELSE '[context]' || chr(10) || string_agg(role || ': ' || text, chr(10) ORDER BY n) FILTER (NOT own) || chr(10) || chr(10) END || string_agg(role || ': ' || text, chr(10) ORDER BY n) FILTER (own) AS text
    FROM o GROUP BY conv_id, win HAVING bool_or(own)""")
def dialogue_windows(spark, d):
    return V.dialogue_windows(table(spark, d, "conversations"), size=3, context=1, doc="conv_id")


# ---- calendar and time


@query("""WITH r AS (SELECT s_suppkey AS id, [s_suppkey % 7, (s_suppkey + 3) % 7] AS days, lpad((s_suppkey % 24)::VARCHAR, 2, '0') || ':' || lpad((s_suppkey * 7 % 60)::VARCHAR, 2, '0') AS local, (30 + s_suppkey % 5 * 300)::INT AS minutes FROM supplier),
    d AS (SELECT unnest(generate_series(DATE '2023-12-30', DATE '2024-01-23', INTERVAL 1 DAY))::DATE AS day)
    SELECT id, day, (day + local::TIME)::TIMESTAMP AS start, (day + local::TIME)::TIMESTAMP + minutes * INTERVAL 1 MINUTE AS "end" FROM r, d
    WHERE list_contains(days, isodow(day) - 1) AND (day + local::TIME)::TIMESTAMP < TIMESTAMP '2024-01-22' AND (day + local::TIME)::TIMESTAMP + minutes * INTERVAL 1 MINUTE > TIMESTAMP '2024-01-01'""")
def weekly_recurrence(spark, d):
    k = F.col("s_suppkey")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    rules = table(spark, d, "supplier").select(
        k.alias("id"), F.array((k % 7).cast("int"), ((k + 3) % 7).cast("int")).alias("weekdays"), F.concat(two(k % 24), F.lit(":"), two(k * 7 % 60)).alias("start_local"),
        (30 + k % 5 * 300).cast("int").alias("minutes"), F.lit("UTC").alias("timezone"),
    )
    out = C.weekly_occurrences(rules, "2024-01-01", "2024-01-22")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query(f"""WITH {_ROWS}, e AS (SELECT id, created_at AS s, created_at + 7200 AS e, id % 4 AS lx, (id % 10) / 10.0::DOUBLE AS se FROM rows_),
    k AS (SELECT *, round(10 * (lx + se) + CASE WHEN s <= 1705276800 AND e > 1705276800 THEN 2 ELSE 1 / (1 + greatest(0, s - 1705276800) / 86400) END, 6) AS score FROM e WHERE lx + se > 0)
    SELECT id, score FROM k ORDER BY score DESC, s, e, id LIMIT 20""")
def calendar_rank(spark, d):
    e = remembered(spark, d).select("id", F.col("created_at").alias("start"), (F.col("created_at") + 7200).alias("end"), (F.col("id") % 4).alias("lexical"), (F.col("id") % 10 / 10.0).alias("semantic"), F.lit(0.0).alias("temporal"))
    return C.calendar_ranked(e, 1705276800.0, 20).select("id", r6("score").alias("score"))


@query(f"""WITH {_ROWS}, o AS (SELECT user_id AS actor, created_at AS s, created_at + 7200 AS e, id % 5 AS p, id FROM rows_), i AS (SELECT DISTINCT user_id AS actor, 1705276800 + 3600 * (user_id % 50) AS t FROM rows_)
    SELECT i.actor, t::DOUBLE AS instant, arg_max(o.id, (p, s, o.id)) AS routine FROM o JOIN i ON o.actor = i.actor AND s <= t AND t < e GROUP BY ALL""")
def active_routine(spark, d):
    rows = remembered(spark, d)
    o = rows.select(F.col("user_id").alias("actor"), F.col("created_at").alias("start"), (F.col("created_at") + 7200).alias("end"), (F.col("id") % 5).alias("priority"), F.col("id").alias("routine"))
    return C.active_routine(o, rows.select(F.col("user_id").alias("actor"), (1705276800.0 + 3600 * (F.col("user_id") % 50)).alias("instant")).distinct())


@query("""SELECT o_orderkey, (CASE WHEN m > 0 AND (day(TIMESTAMP '2024-02-15') < day(o)) THEN m - 1 ELSE m END)::BIGINT AS months FROM (SELECT o_orderkey, o_orderdate::TIMESTAMP AS o, (2024 - year(o_orderdate)) * 12 + 2 - month(o_orderdate) AS m FROM orders)""")
def time_difference_months(spark, d):
    return table(spark, d, "orders").select("o_orderkey", T.months_between(F.col("o_orderdate").cast("timestamp_ntz"), F.expr("timestamp_ntz'2024-02-15 00:00:00'")).alias("months"))


@query("""WITH e AS (SELECT conv_id || '-' || turn AS query_id, [{'x': '3 days ago', 's': 1706486400, 'n': 1, 'g': 'day', 'c': 1.0}, {'x': 'next month', 's': 1709251200, 'n': 31, 'g': 'month', 'c': 1.0}, {'x': '2024-01-05', 's': 1704412800, 'n': 1, 'g': 'day', 'c': 0.9}][turn % 3 + 1] AS r FROM conversations WHERE text IS NOT NULL)
    SELECT query_id, r.s::DOUBLE AS start, (r.s + 86400 * r.n)::DOUBLE AS "end", r.g AS grain, r.c::DOUBLE AS confidence, 1.0::DOUBLE AS query_weight, r.x AS expression FROM e""")
def resolved_expressions(spark, d):
    asked = table(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("query_id"), F.concat(F.col("text"), F.element_at(F.array(F.lit(" 3 days ago"), F.lit(" next month"), F.lit(" on 2024-01-05")), (F.col("turn") % 3 + 1).cast("int"))).alias("text"), F.lit(1.0).alias("weight"))
    return temporal.resolved(asked, NOW)



@query("""WITH e AS (SELECT doc_id, lang, (doc_id % 9 + 1)::INT AS n, doc_id % 3 AS k FROM documents WHERE lang IN ('en', 'de', 'fr', 'es')), w AS (SELECT MAP {'en': [' days ago', 'last month', 'Tomorrow'], 'de': ['vor ', 'letzten Monat', 'Morgen'], 'fr': ['il y a ', 'le mois dernier', 'demain'], 'es': ['hace ', 'el mes pasado', 'mañana']} AS t)
    SELECT doc_id::VARCHAR AS query_id, CASE k WHEN 0 THEN 1706745600 - n * 86400 WHEN 1 THEN 1704067200 ELSE 1706832000 END::DOUBLE AS start, CASE k WHEN 0 THEN 'day' WHEN 1 THEN 'month' ELSE 'day' END AS grain,
        CASE WHEN k > 0 THEN t[lang][k + 1] WHEN lang = 'en' THEN n || ' days ago' ELSE t[lang][1] || n || CASE lang WHEN 'de' THEN ' Tagen' WHEN 'fr' THEN ' jours' ELSE ' días' END END AS expression FROM e, w""")
def locale_expressions(spark, d):
    k, n = F.col("doc_id"), (F.col("doc_id") % 9 + 1).cast("string")
    parts = {"en": ("", " days ago", "last month", "Tomorrow"), "de": ("vor ", " Tagen", "letzten Monat", "Morgen"), "fr": ("il y a ", " jours", "le mois dernier", "demain"), "es": ("hace ", " días", "el mes pasado", "mañana")}
    said = lambda p: F.when(k % 3 == 0, F.concat(F.lit(p[0]), n, F.lit(p[1]))).when(k % 3 == 1, p[2]).otherwise(p[3])
    text = F.coalesce(*[F.when(F.col("lang") == lang, said(p)) for lang, p in parts.items()])
    asked = table(spark, d, "documents").select(k.alias("query_id"), F.concat(F.col("source"), F.lit(", "), text, F.lit("!")).alias("text"), F.lit(1.0).alias("weight")).where("text is not null")
    return temporal.resolved(asked, NOW).select("query_id", "start", "grain", "expression")


# ---- dedup


@query("""SELECT doc_id AS id, first AS survivor FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY lang, lower(trim(text))) AS first FROM documents WHERE trim(text) <> '') WHERE doc_id <> first""")
def dedup_exact(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang", F.col("text").alias("content"), F.lit(0.0).alias("created_at"))
    return E.exact_duplicates(rows, "lang")


@query(f"""WITH {_ROWS}, m AS (SELECT *, id - id % 4 AS s FROM rows_) SELECT s AS id, round(max(importance), 6) AS importance, sum(recall_count)::BIGINT AS recall_count, min(created_at) AS created_at
    FROM m GROUP BY s HAVING bool_or(id = s)""")
def merge_rows(spark, d):
    rows = remembered(spark, d).select("id", "importance", "recall_count", "created_at")
    merges = rows.where("id % 4 <> 0").select("id", (F.col("id") - F.col("id") % 4).alias("survivor"))
    return E.merged_rows(rows, merges).withColumn("importance", r6("importance"))


@query("""WITH RECURSIVE e AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings),
    s AS (SELECT label, 0::BIGINT AS n, []::STRUCT(id BIGINT, v DOUBLE[])[] AS left_, NULL::BIGINT AS id, NULL::STRUCT(s DOUBLE, i BIGINT) AS best FROM (SELECT DISTINCT label FROM e)
          UNION ALL SELECT label, n, CASE WHEN best.s >= 0.25 THEN left_ ELSE list_append(left_, {'id': id, 'v': v}) END, id, best
          FROM (SELECT e.label, e.n, e.id, e.v, s.left_, list_max(list_transform(s.left_, lambda x: {'s': list_cosine_similarity(x.v, e.v), 'i': -x.id})) AS best FROM s JOIN e ON e.label = s.label AND e.n = s.n + 1))
    SELECT id, (-best.i)::BIGINT AS survivor, round(best.s, 6) AS similarity FROM s WHERE best.s >= 0.25""")
def dedup_cosine_sweep(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("user_id"), F.col("vec_id").cast("double").alias("created_at"), F.lit("").alias("content"), F.col("embedding").alias("vec"))
    return E.greedy_sweep(rows, threshold=0.25).withColumn("similarity", r6("similarity"))


@query("""WITH p AS (SELECT vec_id, abs(embedding[1]::DOUBLE) / (abs(embedding[1]::DOUBLE) + 0.005) AS a, 1 - abs(embedding[1]::DOUBLE) / (abs(embedding[1]::DOUBLE) + 0.005) AS b FROM embeddings)
    SELECT vec_id, a >= 0.98 AND a - b >= 0.2 AS accepted FROM p""")
def decision_acceptance(spark, d):
    a = F.abs(F.get("embedding", F.lit(0)).cast("double"))
    p = a / (a + 0.005)
    return table(spark, d, "embeddings").select("vec_id", E.accepted(F.create_map(F.lit("equivalent"), p, F.lit("distinct"), 1 - p), F.lit("equivalent")).alias("accepted"))


# ---- graph: customers know the orders that they placed, orders hold lines of parts

_EDGES = """edges AS (SELECT 'c' || o_custkey AS src, 'o' || o_orderkey AS dst, 'episode' AS kind, (0.3 + (o_orderkey % 7) / 10.0)::DOUBLE AS weight FROM orders
    UNION ALL SELECT 'o' || l_orderkey, 'p' || l_partkey, 'co_occurrence', ((l_linenumber % 5) / 10.0)::DOUBLE FROM lineitem)"""
_WALKS = f"{_EDGES}, walks AS (SELECT src, dst, CASE WHEN weight = 0 THEN 0.5 ELSE weight END AS strength FROM edges UNION ALL SELECT dst, src, CASE WHEN weight = 0 THEN 0.5 ELSE weight END FROM edges WHERE kind = 'co_occurrence')"


_NODES = """nodes AS (SELECT 'c' || c_custkey AS id, 'person' AS kind, least(1.5::DOUBLE, greatest(0.4::DOUBLE, 0.6::DOUBLE * (c_custkey % 10) / 10 + 0.2::DOUBLE)) AS strength FROM customer
    UNION ALL SELECT 'o' || o_orderkey, 'episode', greatest(0.4::DOUBLE, 0.6::DOUBLE * (o_orderkey % 7) / 7 + 0.2::DOUBLE, 0.4::DOUBLE * (o_orderkey % 5) / 5 + 0.2::DOUBLE) FROM orders
    UNION ALL SELECT 'p' || p_partkey, 'fact', greatest(0.4::DOUBLE, 0.4::DOUBLE * (p_partkey % 4) / 4 + 0.2::DOUBLE) FROM part)"""
_REACHED = f"{_WALKS}, {_NODES}, reached AS (SELECT w.src, w.dst, w.strength * n.strength AS strength FROM walks w JOIN nodes n ON n.id = w.dst), fans AS (SELECT src, count(*) AS fan FROM reached GROUP BY src)"


def _nodes(spark, d) -> DataFrame:
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string")).alias("id")
    none = F.lit(None).cast("double")
    own = [
        table(spark, d, "customer").select(name("c", "c_custkey"), F.lit("person").alias("kind"), (F.col("c_custkey") % 10 / 10).alias("importance"), none.alias("confidence")),
        table(spark, d, "orders").select(name("o", "o_orderkey"), F.lit("episode").alias("kind"), (F.col("o_orderkey") % 7 / 7).alias("importance"), (F.col("o_orderkey") % 5 / 5).alias("confidence")),
        table(spark, d, "part").select(name("p", "p_partkey"), F.lit("fact").alias("kind"), none.alias("importance"), (F.col("p_partkey") % 4 / 4).alias("confidence")),
    ]
    nodes = own[0].unionByName(own[1]).unionByName(own[2])
    return nodes.withColumn("strength", S.node_strength(F.col("importance"), F.col("confidence")))


def _edges(spark, d) -> DataFrame:
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    orders = table(spark, d, "orders").select(name("c", "o_custkey").alias("src"), name("o", "o_orderkey").alias("dst"), F.lit("episode").alias("kind"), (0.3 + F.col("o_orderkey") % 7 / 10.0).alias("weight"))
    lines = table(spark, d, "lineitem").select(name("o", "l_orderkey").alias("src"), name("p", "l_partkey").alias("dst"), F.lit("co_occurrence").alias("kind"), (F.col("l_linenumber") % 5 / 10.0).alias("weight"))
    return orders.unionByName(lines)


def _walks(spark, d) -> DataFrame:
    return G.walks(_edges(spark, d)).select("src", "dst", S.edge_strength(F.lit("co_occurrence"), F.col("weight")).alias("strength"))


@query(f"WITH {_WALKS} SELECT src AS id, count(*) AS walks FROM walks GROUP BY src")
def adjacency_view(spark, d):
    return _walks(spark, d).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("walks"))


def _spread_sql(hops: int) -> str:
    steps = ", ".join(f"f{h} AS (SELECT r.dst AS id, sum({0.35 * 0.6 ** (h - 1)!r} * f.mass * r.strength / n.fan) AS mass FROM f{h - 1} f JOIN reached r ON r.src = f.id JOIN fans n ON n.src = f.id GROUP BY r.dst)" for h in range(1, hops + 1))
    total = " UNION ALL ".join(f"SELECT * FROM f{h}" for h in range(hops + 1))
    return f"""WITH {_REACHED}, f0 AS (SELECT 'c' || c_custkey AS id, 0.8::DOUBLE AS mass FROM customer WHERE c_custkey % 20 = 0), {steps}
        SELECT id, round(sum(mass) + 1e-10, 6) AS activation FROM ({total}) GROUP BY id"""


def _spread(spark, d, hops: int) -> DataFrame:
    seeds = table(spark, d, "customer").where("c_custkey % 20 = 0").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.lit(0.8).alias("activation"))
    return G.spread(_walks(spark, d), seeds, hops=hops, nodes=_nodes(spark, d)).withColumn("activation", r6(F.col("activation") + 1e-10))


@query(_spread_sql(1))
def spread_one_hop(spark, d):
    return _spread(spark, d, 1)


@query(_spread_sql(2))
def spread_two_hops(spark, d):
    return _spread(spark, d, 2)


@query(f"""WITH {_ROWS}, b AS (SELECT *, CASE WHEN id % 50 = 0 THEN 0 WHEN id % 51 > 0 THEN created_at END AS c FROM rows_), a AS (SELECT *, greatest(0.001::DOUBLE, 1705276800 - c) AS age FROM b)
    SELECT id, round(least(1.5, greatest(0.4, 0.6 * importance + 0.2, 0.4 * (id % 10) / 10.0::DOUBLE + 0.2)), 6) AS strength,
    round(CASE WHEN c > 0 THEN greatest(-2, ln(pow(age, -0.5) * exp(-age / 1209600))) + ln(1 + 0.1::DOUBLE * recall_count / (recall_count + 10.0::DOUBLE)) ELSE -2 END, 6) AS base_level FROM a""")
def node_activation(spark, d):
    created = F.when(F.col("id") % 50 == 0, 0.0).when(F.col("id") % 51 > 0, F.col("created_at"))
    return remembered(spark, d).select("id", r6(S.node_strength(F.col("importance"), F.col("id") % 10 / 10.0)).alias("strength"), r6(S.base_level(1705276800.0, created, F.col("recall_count"))).alias("base_level"))


@query("""SELECT event_id, round(least(1, greatest(CASE WHEN w = 0 THEN 0.5 ELSE w END, 0.5 + 0.5 * c, 0.5 + 0.5 * i, 0.3 + 0.5 * c)), 6) AS strength FROM (SELECT event_id, (event_id % 11) / 10.0::DOUBLE AS w, (event_id % 7) / 10.0::DOUBLE AS c, least(1, value / 1000)::DOUBLE AS i FROM events)""")
def edge_strengths(spark, d):
    s = S.edge_strength(F.lit("fact"), F.col("event_id") % 11 / 10.0, confidence=F.col("event_id") % 7 / 10.0, importance=F.least(F.lit(1.0), F.col("value") / 1000))
    return table(spark, d, "events").select("event_id", r6(s).alias("strength"))


@query("SELECT DISTINCT a.l_partkey AS a, b.l_partkey AS b FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey")
def cooccurrence_pairs(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_partkey").alias("node"), F.col("l_orderkey").alias("participant"))
    return G.shared_pairs(lines)


@query("""WITH f AS (SELECT DISTINCT l_orderkey AS r, l_partkey AS n FROM lineitem WHERE l_discount >= 0.03), p AS (SELECT DISTINCT a.n AS src, b.n AS dst FROM f a JOIN f b ON a.r = b.r AND a.n < b.n),
    o AS (SELECT DISTINCT l_orderkey AS r, l_partkey AS n FROM lineitem WHERE l_discount >= 0.08), e AS (SELECT DISTINCT a.n AS src, b.n AS dst, 0.1::DOUBLE AS weight FROM o a JOIN o b ON a.r = b.r AND a.n < b.n)
    SELECT coalesce(e.src, p.src) AS src, coalesce(e.dst, p.dst) AS dst, round(CASE WHEN e.src IS NULL THEN 0.1 ELSE 0.15 END::DOUBLE, 6) AS weight, 1::BIGINT AS co_recall_count FROM e FULL JOIN p ON e.src = p.src AND e.dst = p.dst""")
def hebbian_update(spark, d):
    lines = table(spark, d, "lineitem")
    fired = lines.select(F.col("l_orderkey").alias("recall"), F.col("l_partkey").alias("id"), (F.col("l_discount") * 5).alias("activation"))
    old = G.shared_pairs(lines.where(F.col("l_discount") >= 0.08).select(F.col("l_partkey").alias("node"), F.col("l_orderkey").alias("recall")), "node", "recall")
    edges = old.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(0.1).alias("weight"), F.lit(0.1).alias("creation_weight"), F.lit(0).cast("long").alias("co_recall_count"))
    return G.hebbian(edges, fired).select("src", "dst", r6("weight").alias("weight"), "co_recall_count")


@query("""WITH RECURSIVE l AS (SELECT c_custkey AS id, 'n' || (c_custkey // 6 * 6 + c_custkey % 2) AS label FROM customer UNION ALL SELECT c_custkey, 'm' || (c_custkey // 3) FROM customer),
    e AS (SELECT DISTINCT a.id AS a, b.id AS b FROM l a JOIN l b USING (label)), r(id, root) AS (SELECT id, id FROM l UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id WHERE r.root < e.b)
    SELECT id, min(root) AS component FROM r GROUP BY id""")
def person_components(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    labels = c.select("id", F.concat(F.lit("n"), F.expr("id div 6 * 6 + id % 2").cast("string")).alias("label"))
    more = c.select("id", F.concat(F.lit("m"), F.expr("id div 3").cast("string")).alias("label"))
    return G.label_components(labels.unionByName(more))


@query("""WITH e AS (SELECT l_orderkey % 100 AS a, l_partkey % 100 AS b, (l_linenumber / 10.0)::DOUBLE AS w, (l_discount - 0.05)::DOUBLE AS t FROM lineitem)
    SELECT 'e:chat:' || least(a::VARCHAR, b::VARCHAR) || '::' || greatest(a::VARCHAR, b::VARCHAR) AS id, round(max(w), 6) AS weight, round(max(abs(t)), 6) AS trust_size FROM e GROUP BY 1""")
def edge_merge(spark, d):
    a, b = (F.col("l_orderkey") % 100).cast("string"), (F.col("l_partkey") % 100).cast("string")
    e = table(spark, d, "lineitem").select(S.edge_id(F.lit("chat"), a, b).alias("id"), F.lit("chat").alias("kind"), a.alias("src"), b.alias("dst"), (F.col("l_linenumber") / 10.0).cast("double").alias("weight"), (F.col("l_discount") - 0.05).cast("double").alias("trust"))
    return G.merged_edges(e).select("id", r6("weight").alias("weight"), r6(F.abs("trust")).alias("trust_size"))


@query(f"""WITH {_EDGES}, v AS (SELECT 'c' || c_custkey AS id FROM customer WHERE c_nationkey < 13 UNION ALL SELECT 'o' || o_orderkey FROM orders),
    x AS (SELECT src, dst FROM edges WHERE src IN (SELECT id FROM v) AND dst IN (SELECT id FROM v)), n AS (SELECT src AS id FROM x UNION ALL SELECT dst FROM x)
    SELECT v.id, count(n.id) AS degree FROM v LEFT JOIN n ON v.id = n.id GROUP BY v.id HAVING count(n.id) >= 2""")
def minimum_degree(spark, d):
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string")).alias("id")
    nodes = table(spark, d, "customer").where("c_nationkey < 13").select(name("c", "c_custkey")).unionByName(table(spark, d, "orders").select(name("o", "o_orderkey")))
    return G.degrees(_edges(spark, d), nodes).where("degree >= 2")


@query("""WITH e AS (SELECT doc_id, list_distinct(['u' || (doc_id % 5), 'u' || (doc_id % 3)]) AS owners, doc_id % 11 = 0 AS scoped FROM documents) SELECT doc_id AS id FROM e WHERE scoped OR list_has_any(owners, ['u4'])""")
def visible_nodes(spark, d):
    u = lambda n: F.concat(F.lit("u"), (F.col("doc_id") % n).cast("string"))
    nodes = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.array_distinct(F.array(u(5), u(3))).alias("owners"), (F.col("doc_id") % 11 == 0).alias("character_scoped"))
    return G.visible(nodes, ["u4"]).select("id")


@query("""WITH c AS (SELECT o_orderkey, 'u' || (o_custkey % 9) AS o, o_custkey FROM orders) SELECT 'c' || k.c_custkey AS id, coalesce(array_to_string(list_sort(list_distinct(list(c.o) FILTER (c.o IS NOT NULL))), ','), '') AS owners FROM customer k LEFT JOIN c ON c.o_custkey = k.c_custkey GROUP BY k.c_custkey""")
def owner_backfill(spark, d):
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    persons = table(spark, d, "customer").select(name("c", "c_custkey").alias("id"), F.lit("person").alias("kind"), F.array().cast("array<string>").alias("owners"))
    episodes = table(spark, d, "orders").select(name("o", "o_orderkey").alias("id"), F.lit("episode").alias("kind"), F.array(F.concat(F.lit("u"), (F.col("o_custkey") % 9).cast("string"))).alias("owners"))
    out = G.owners_from_content(persons.unionByName(episodes), _edges(spark, d).where("kind = 'episode'"))
    return out.where("kind = 'person'").select("id", F.array_join("owners", ",").alias("owners"))


@query("""WITH h AS (SELECT label AS query_id, vec_id AS id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS rank, (vec_id % 10) / 10.0::DOUBLE AS relevance, (vec_id % 7) / 100.0::DOUBLE AS score FROM embeddings QUALIFY rank < 8)
    SELECT query_id, id, round(4 * (1 - 0.6 * rank / count(*) OVER (PARTITION BY query_id)) * relevance + 3 * score, 6) AS activation FROM h""")
def seed_activations(spark, d):
    from pyspark.sql import Window

    hits = table(spark, d, "embeddings").select(F.col("label").alias("query_id"), F.col("vec_id").alias("id"), (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).alias("rank"), (F.col("vec_id") % 10 / 10.0).alias("relevance"), (F.col("vec_id") % 7 / 100.0).alias("score"))
    return G.seed_activations(hits.where("rank < 8")).withColumn("activation", r6("activation"))


# ---- functions and chunks


@query(r"SELECT doc_id, CASE WHEN s = '' THEN 'entity' ELSE s END AS slug FROM (SELECT doc_id, regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM documents)")
def slugs(spark, d):
    return table(spark, d, "documents").select("doc_id", T.slugify(F.col("text")).alias("slug"))


@query("""WITH e AS (SELECT vec_id, greatest(0, least(1, embedding[1]::DOUBLE)) AS a, greatest(0, least(1, embedding[2]::DOUBLE)) AS b FROM embeddings)
    SELECT vec_id, round(least(1, sqrt(a * a + b * b)), 6) AS impact, round(CASE WHEN a * a + b * b > 0 THEN greatest(0, least(1, (a * 0.6::DOUBLE + b * 0.8::DOUBLE) / sqrt(a * a + b * b))) ELSE 0 END, 6) AS likeness FROM e""")
def emotion_vectors(spark, d):
    values = F.create_map(F.lit("joy"), F.get("embedding", F.lit(0)).cast("double"), F.lit("fear"), F.get("embedding", F.lit(1)).cast("double"), F.lit("noise"), F.lit(1.0))
    own = T.emotion(values, ["joy", "fear"])
    mood = F.create_map(F.lit("joy"), F.lit(0.6), F.lit("fear"), F.lit(0.8))
    return table(spark, d, "embeddings").select("vec_id", r6(T.emotional_impact(own)).alias("impact"), r6(T.emotion_similarity(own, mood)).alias("likeness"))


@query()
def markdown_chunks(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("# "), F.col("source"), F.lit("\n\n"), F.regexp_replace("text", "\n", "\n\n## part\n\n")).alias("text"))
    return chunking.chunked(docs)


@query("""WITH a AS (SELECT event_id, user_id, value FROM events WHERE event_id % 9 <> 0), b AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN user_id + 1 ELSE user_id END AS user_id, value + event_id % 2 AS value FROM events WHERE event_id % 8 <> 0)
    SELECT coalesce(a.event_id, b.event_id) AS event_id, CASE WHEN b.event_id IS NULL THEN 'delete' ELSE 'upsert' END AS action FROM a FULL JOIN b ON a.event_id = b.event_id WHERE a.user_id IS DISTINCT FROM b.user_id""")
def change_feed(spark, d):
    rows = table(spark, d, "events").select("event_id", "user_id", "value")
    after = rows.where("event_id % 8 <> 0").withColumns({"user_id": F.when(F.col("event_id") % 5 == 0, F.col("user_id") + 1).otherwise(F.col("user_id")), "value": F.col("value") + F.col("event_id") % 2})
    return I.tracked_changes(rows.where("event_id % 9 <> 0"), after, "event_id", ("value",))


@query("SELECT event_id AS id, user_id AS character, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS sequence FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 25")
def bounded_history(spark, d):
    return I.bounded_history(table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("character")))


# ---- the write path


@query("""WITH x AS (SELECT doc_id AS id, source AS user_id, text AS content, [doc_id % 50, doc_id % 70] AS m FROM documents), k AS (SELECT DISTINCT source AS user_id, lower(trim(text)) AS t FROM documents WHERE lang = 'fr'),
    c AS (SELECT *, list_sort(list_distinct(list_filter(m, lambda i: i % 3 <> 0))) AS ids FROM x), f AS (SELECT * FROM c WHERE len(ids) > 0 AND trim(content) <> ''),
    o AS (SELECT *, row_number() OVER (PARTITION BY user_id, lower(trim(content)) ORDER BY id) AS n FROM f)
    SELECT id, user_id, ids AS source_message_ids FROM o WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM k WHERE k.user_id = o.user_id AND k.t = lower(trim(o.content)))""")
def applied_facts(spark, d):
    docs = table(spark, d, "documents")
    rows = docs.select(F.col("doc_id").alias("id"), F.col("source").alias("user_id"), F.col("text").alias("content"), F.array(F.col("doc_id") % 50, F.col("doc_id") % 70).alias("source_message_ids"))
    known = docs.where("lang = 'fr'").select(F.col("source").alias("user_id"), F.col("text").alias("content"))
    return M.applied_facts(rows, known, spark.range(70).where("id % 3 <> 0")).select("id", "user_id", "source_message_ids")


@query("""WITH RECURSIVE h AS (SELECT user_id AS thread, ['create', 'resolve', 'reopen', 'dismiss', 'update'][(event_id * 7 + user_id) % 5 + 1] AS action, CASE WHEN event_id % 3 = 0 THEN '  ' ELSE 'c' || event_id END AS content,
            CASE WHEN event_id % 4 = 0 THEN ' ' ELSE 't' || event_id END AS text, CASE WHEN event_id % 5 = 0 THEN 'f' || event_id END AS follow_up, CASE WHEN event_id % 7 = 0 THEN event_id::DOUBLE END AS not_before, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
    s AS (SELECT thread, 0::BIGINT AS n, NULL::VARCHAR AS status, NULL::VARCHAR AS content, NULL::VARCHAR AS follow_up, NULL::DOUBLE AS not_before, NULL::VARCHAR AS resolution FROM (SELECT DISTINCT thread FROM h)
          UNION ALL SELECT s.thread, h.n, CASE WHEN opens THEN 'open' WHEN closes THEN h.action || CASE WHEN h.action = 'resolve' THEN 'd' ELSE 'ed' END ELSE s.status END, CASE WHEN changes AND trim(h.content) <> '' THEN h.content ELSE s.content END,
          CASE WHEN changes THEN coalesce(h.follow_up, s.follow_up) ELSE s.follow_up END, CASE WHEN changes THEN coalesce(h.not_before, s.not_before) ELSE s.not_before END, CASE WHEN closes THEN h.text WHEN opens THEN NULL ELSE s.resolution END
          FROM s JOIN h ON h.thread = s.thread AND h.n = s.n + 1, LATERAL (SELECT coalesce((h.action = 'create' AND s.status IS NULL AND trim(h.content) <> '') OR (h.action = 'reopen' AND s.status IS NOT NULL), false) AS opens,
              coalesce(h.action IN ('resolve', 'dismiss') AND s.status = 'open' AND trim(h.text) <> '', false) AS closes, coalesce(h.action = 'update' AND s.status = 'open', false) AS updates), LATERAL (SELECT opens OR closes OR updates AS changes))
    SELECT thread, status, content, coalesce(follow_up, '') AS follow_up, not_before, resolution FROM s WHERE status IS NOT NULL QUALIFY row_number() OVER (PARTITION BY thread ORDER BY n DESC) = 1""")
def thread_states(spark, d):
    k, names = F.col("event_id"), F.array(*map(F.lit, ["create", "resolve", "reopen", "dismiss", "update"]))
    some = lambda letter: F.concat(F.lit(letter), k.cast("string"))
    updates = table(spark, d, "events").select(
        F.col("user_id").alias("thread"), k.alias("seq"), F.get(names, ((k * 7 + F.col("user_id")) % 5).cast("int")).alias("action"), F.when(k % 3 == 0, "  ").otherwise(some("c")).alias("content"), F.when(k % 5 == 0, some("f")).alias("follow_up"),
        F.when(k % 7 == 0, k.cast("double")).alias("not_before"), F.when(k % 4 == 0, " ").otherwise(some("t")).alias("resolution"), T.epoch(F.col("ts")).alias("at"),
    )
    return M.thread_states(updates).drop("resolved_at")


@query(f"WITH {_MSG}, t AS (SELECT chat_id, arg_max(trim(regexp_replace(content, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')), id) AS t FROM messages WHERE role = 'user' AND trim(content) <> '' GROUP BY chat_id) SELECT chat_id, CASE WHEN length(t) > 160 THEN substr(t, 1, 159) || '…' ELSE t END AS preview FROM t")
def run_preview(spark, d):
    return M.preview(messages(spark, d))


@query(f"WITH {_ROWS} SELECT type AS memory, count(*) AS rows, count(DISTINCT user_id) AS users FROM rows_ GROUP BY type")
def memory_overview(spark, d):
    return M.overview(remembered(spark, d), "type")


@query(f"WITH {_ROWS} SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY importance DESC, id) AS rank FROM rows_ QUALIFY rank <= 8")
def known_facts(spark, d):
    return M.known_facts(remembered(spark, d)).select("user_id", "id", "rank")


@query(f"""WITH {_ROWS}, b AS (SELECT user_id % 20 AS p, id % 100 AS node, round(importance, 6) AS s FROM rows_), n AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY s DESC, node) AS r FROM (SELECT p, node, max(s) AS s FROM b GROUP BY ALL) QUALIFY r <= 10)
    SELECT node AS id, max(s) AS score, arg_max(p, (s, p)) AS participant FROM n GROUP BY node""")
def participant_fan_out(spark, d):
    items = remembered(spark, d).select((F.col("user_id") % 20).alias("participant"), (F.col("id") % 100).alias("id"), r6("importance").alias("score")).groupBy("participant", "id").agg(F.max("score").alias("score"))
    return M.fan_out(items, spark.range(20).withColumnRenamed("id", "participant"), 10)


@query("""WITH a AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings), l AS (SELECT vec_id AS user_id, 'joy' AS axis, x AS before, CASE WHEN vec_id % 2 = 0 THEN x ELSE x + 0.25 END AS after FROM a UNION ALL SELECT vec_id, 'fear', y, 0 FROM a)
    SELECT user_id, axis, round(after - before, 6) AS delta FROM l WHERE abs(after - before) > 1e-9""")
def emotion_changes(spark, d):
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("user_id"), at(0).alias("x"), at(1).alias("y"))
    before = vectors.select("user_id", F.create_map(F.lit("joy"), F.col("x"), F.lit("fear"), F.col("y")).alias("dims"))
    after = vectors.select("user_id", F.create_map(F.lit("joy"), F.when(F.col("user_id") % 2 == 0, F.col("x")).otherwise(F.col("x") + 0.25)).alias("dims"))
    return M.emotion_changes(before, after).select("user_id", "axis", r6("delta").alias("delta"))


@query("""WITH a AS (SELECT vec_id, embedding[1]::DOUBLE AS x FROM embeddings), b AS (SELECT vec_id AS user_id, CASE WHEN vec_id % 2 = 0 THEN 0 ELSE 1 END + CASE WHEN vec_id % 5 = 0 AND x <> 0 THEN 1 ELSE 0 END AS axes, CASE WHEN vec_id % 3 = 0 THEN '' ELSE 'c' || (vec_id % 4) END AS comment_before, CASE WHEN vec_id % 7 = 0 THEN 'new' WHEN vec_id % 3 = 0 THEN '' ELSE 'c' || (vec_id % 4) END AS comment_after FROM a)
    SELECT user_id, axes::BIGINT AS axes, comment_before, comment_after, comment_before <> comment_after AS comment_changed FROM b WHERE axes > 0 OR comment_before <> comment_after""")
def relation_changes(spark, d):
    k, x = F.col("user_id"), F.get("embedding", F.lit(0)).cast("double")
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("user_id"), x.alias("x"))
    comment = F.when(k % 3 > 0, F.concat(F.lit("c"), (k % 4).cast("string")))
    before = rows.select("user_id", F.create_map(F.lit("joy"), F.lit(0.5), F.lit("fear"), F.col("x")).alias("dims"), comment.alias("comment"))
    after = rows.select("user_id", F.create_map(F.lit("joy"), F.when(k % 2 == 0, 0.5).otherwise(0.75), F.lit("fear"), F.when(k % 5 == 0, 0.0).otherwise(F.col("x"))).alias("dims"), F.when(k % 7 == 0, "new").otherwise(comment).alias("comment"))
    return M.relation_changes(before, after).select("user_id", F.col("axes").cast("long").alias("axes"), "comment_before", "comment_after", "comment_changed")


@query(f"""WITH {_ROWS} SELECT 'e:fact:person:' || user_id || '->fact:' || id AS id, round(greatest(0.3, least(1, 0.3 + 0.7 * importance)), 6) AS weight FROM rows_""")
def fact_graph(spark, d):
    _, edges = M.fact_graph(remembered(spark, d).withColumn("confidence", F.lit(0.5)).withColumn("user_id", F.col("user_id").cast("string")))
    return edges.select("id", r6("weight").alias("weight"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_custkey % 10 = 0 THEN 'self' WHEN o_custkey % 10 < 4 THEN 'p' || o_custkey WHEN o_custkey % 10 < 7 THEN 'p' || o_custkey ELSE 'person:ghost-' || (o_custkey % 30) END AS person FROM orders""")
def resolved_subjects(spark, d):
    k = F.col("c_custkey").cast("string")
    people = table(spark, d, "customer").select(F.concat(F.lit("p"), k).alias("id"), F.col("c_name").alias("name"), F.concat(F.lit("u"), k).alias("user_id"), F.array(F.concat(F.lit("Old "), k)).alias("aliases"))
    n = F.col("o_custkey") % 10
    named = F.concat(F.lit("  CUSTOMER#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))
    subject = F.when(n == 0, " the keeper ").when(n < 4, named).when(n < 7, F.concat(F.lit("u"), F.col("o_custkey").cast("string"))).otherwise(F.concat(F.lit("Ghost "), (F.col("o_custkey") % 30).cast("string")))
    facts = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), subject.alias("subject"))
    return M.resolved_subjects(facts, people, ["The Keeper"]).select("id", "person")


# ---- groups and entities


@query(f"""WITH {_REACHED}, s AS (SELECT c_nationkey AS participant, 'c' || c_custkey AS id, 0.48::DOUBLE AS mass FROM customer WHERE c_custkey % 20 = 0),
    f1 AS (SELECT participant, r.dst AS id, 0.35 * s.mass * r.strength / n.fan AS mass FROM s JOIN reached r ON r.src = s.id JOIN fans n ON n.src = s.id)
    SELECT participant, id, round(sum(mass) + 1e-10, 6) AS activation FROM (SELECT * FROM s UNION ALL SELECT * FROM f1) GROUP BY ALL""")
def group_activation(spark, d):
    seeds = table(spark, d, "customer").where("c_custkey % 20 = 0").select(F.col("c_nationkey").alias("participant"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.lit(0.48).alias("activation"))
    out = G.spread(_walks(spark, d), seeds, hops=1, per=["participant"], nodes=_nodes(spark, d))
    return out.select("participant", "id", r6(F.col("activation") + 1e-10).alias("activation"))


@query(f"""WITH {_WALKS}, h0 AS (SELECT 'c' || c_custkey AS id FROM customer WHERE c_custkey % 20 = 0), h1 AS (SELECT DISTINCT dst AS id FROM walks JOIN h0 ON src = h0.id), h2 AS (SELECT DISTINCT dst AS id FROM walks JOIN h1 ON src = h1.id)
    SELECT id, min(hop)::INT AS hop FROM (SELECT id, 0 AS hop FROM h0 UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2) GROUP BY id""")
def subgraph_hops(spark, d):
    seeds = table(spark, d, "customer").where("c_custkey % 20 = 0").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"))
    return G.within_hops(_walks(spark, d), seeds, 2)


@query("""WITH e AS (SELECT 'entity:part-' || p_partkey AS id, 'Part ' || p_partkey AS name, 'alias ' || (p_partkey % 30) AS a FROM part WHERE p_partkey % 3 = 0),
    m AS (SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_partkey % 2 = 0 THEN 'PART  ' || l_partkey ELSE 'Alias ' || (l_partkey % 40) END AS name FROM lineitem),
    s AS (SELECT id, regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g') AS slug FROM m), l AS (SELECT regexp_replace(lower(a), '[^a-z0-9]+', '-', 'g') AS slug, min(id) AS id FROM e GROUP BY 1)
    SELECT s.id, coalesce(e.id, l.id, 'entity:' || s.slug) AS entity FROM s LEFT JOIN e ON e.id = 'entity:' || s.slug LEFT JOIN l ON l.slug = s.slug""")
def entity_resolution(spark, d):
    entities = table(spark, d, "part").where("p_partkey % 3 = 0").select(
        F.concat(F.lit("entity:part-"), F.col("p_partkey").cast("string")).alias("id"), F.concat(F.lit("Part "), F.col("p_partkey").cast("string")).alias("name"),
        F.array(F.concat(F.lit("alias "), (F.col("p_partkey") % 30).cast("string"))).alias("aliases"),
    )
    name = F.when(F.col("l_partkey") % 2 == 0, F.concat(F.lit("PART  "), F.col("l_partkey").cast("string"))).otherwise(F.concat(F.lit("Alias "), (F.col("l_partkey") % 40).cast("string")))
    mentions = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), name.alias("name"))
    return G.resolved_entities(mentions, entities, T.slugify).select("id", "entity")
