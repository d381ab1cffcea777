"""The thin registered queries of the operators: whole tables, production parameters, digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation_repair, decontaminate, exact_dedup, language_id, license_scan, minhash, packing, phrase_mining, quality, suffix_dedup, token_counts, toxicity, url_filter
from .io import table

URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _remainder(by: int):
    """crc32 of the id as text, modulo ``by``."""
    return F.crc32(F.col("doc_id").cast("string")) % by


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary())


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), _remainder(5) == 0)


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "verdict string, host string, path string")
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), rules)


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # over fifty words may have fewer bytes than the window: they are counted and cut in columns of their own
    return suffix_dedup.repeat_digest(table(spark, sf_dir, "documents"), words=51)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary())


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"), _remainder(3) == 1)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    ids = rows.select(F.col("conv_id").cast("long").alias("conv"))
    return conversation_repair.reports(conversation_repair.damaged(rows), ids).withColumnRenamed("conv", "conv_id")


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_mining.collocations(table(spark, sf_dir, "documents"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_packing, op2_minhash_near_dedup, op3_toxicity, op4_url_filters, op5_suffix_array_dedup,
        op6_quality_rules, op7_token_counts, op8_license_scans, op9_benchmark_decontamination, op10_language_id,
        op11_conversation_repair, op12_phrase_collocations, op13_exact_dedup,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op4_url_filters": r"""
        WITH rules(verdict, host, path) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
        rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
        parts AS (SELECT row_number() OVER () AS n, page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                         regexp_extract(substr(r, length(regexp_extract(r, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM rest),
        fits AS (SELECT p.n, r.host || r.path AS rule, r.verdict,
                        row_number() OVER (PARTITION BY p.n ORDER BY length(r.host || r.path) DESC, r.verdict DESC) AS best
                 FROM parts p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
        SELECT p.page_id, coalesce(p.host, '') AS host, coalesce(p.path, '') AS path, f.rule, coalesce(f.verdict, 'allow') AS verdict
        FROM parts p LEFT JOIN fits f ON f.n = p.n AND f.best = 1
    """,
    # the tail of the binomial distribution by the logarithms of its terms; the grids are those of quality.GRIDS
    "op6_quality_rules": quality.oracle_sql(),
    "op12_phrase_collocations": r"""
        WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
        pieces AS (SELECT lang, unnest(string_split_regex(x, '[.,;:!?\x0A-\x0D]')) AS piece FROM t),
        lists AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces),
        starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM lists),
        spans AS (SELECT lang, w, i, unnest([1, 2, 3, 4]) AS m FROM starts),
        f AS (SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS phrase, count(*) AS f FROM spans WHERE i + m - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 30),
        totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM lists GROUP BY lang),
        cand AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
        cuts AS (SELECT *, unnest(range(1, m)) AS k FROM cand),
        scored AS (SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, ((2000000::HUGEINT * c.a) // (x.f::HUGEINT + y.f))::BIGINT AS score
                   FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1 : c.k], ' ')
                   JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1 : c.m], ' ')),
        best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS o FROM scored) WHERE o = 1),
        inner_ AS (SELECT lang, a, w, m, unnest(range(1, m)) AS i FROM cand WHERE m > 2),
        inners AS (SELECT lang, a, w, m, i, unnest(range(2, m)) AS s FROM inner_),
        hidden AS (SELECT lang, array_to_string(w[i : i + s - 1], ' ') AS phrase, max(a) AS outer_a FROM inners WHERE i + s - 1 <= m GROUP BY ALL),
        free AS (SELECT b.* FROM best b LEFT JOIN hidden h USING (lang, phrase) WHERE h.outer_a IS NULL OR 100 * h.outer_a::HUGEINT < 80 * b.a::HUGEINT),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM free)
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
    """,
    "op13_exact_dedup": """
        WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents)
        SELECT doc_id, first(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY x) AS group_size, row_number() OVER w = 1 AS kept, sha256(x) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY x ORDER BY doc_id DESC NULLS LAST)
    """,
}
