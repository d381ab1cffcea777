"""Quality rules with risk-controlled cutoffs, in DataFrame functions throughout.

Base rules need no labels. Further rules compare a measure with a cutoff, and labelled documents select the cutoffs: for each
stratum, rule and candidate cutoff, ``n`` documents labelled good of which ``k`` would be rejected give the exact binomial tail
P(Bin(n, alpha') <= k). A cutoff is certified when the tail is at most delta', that is, when the exact (Clopper-Pearson) upper bound
of its false rejection rate is at most alpha'. Candidates are tested from the strictest on and testing stops at the first failure (fixed sequence);
alpha' = alpha / rules bounds the union of the rules, and delta' = delta / (rules * strata) corrects for the tests (Bonferroni).
Among certified cutoffs the one with the best balance of bad and good documents rejected is used; a stratum with too few labels
certifies nothing, and its documents are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .io import saved

SPACES = "[\\x20\\x09-\\x0D]+"
WINDOW = 5
#: measure: candidate cutoffs, strictest first
GRIDS: dict[str, list[float]] = {
    "symbol_share": [2.0, 1.5, 1.2, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1],
    "dup_line_share": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2],
    "long_word": [40.0, 30.0, 25.0, 20.0, 17.0, 15.0, 13.0, 12.0],
}
ALPHA, DELTA, GOOD_COST = 0.02, 0.05, 10.0


def base_measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum: Column | None = None, also: tuple[str, ...] = ()) -> DataFrame:
    """id, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines for each row, and the columns in ``also``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    stratum = F.lit("all") if stratum is None else F.coalesce(stratum.cast("string"), F.lit("und"))
    a = docs.select(F.col(id_col).cast("long").alias("id"), stratum.alias("stratum"), text.alias("text"), *also)
    words = F.array_remove(F.split("text", SPACES), "")
    lines = F.filter(F.split("text", "\n"), lambda x: F.regexp_replace(x, SPACES, "") != "")
    a = a.withColumn("words", words).withColumn("lines", lines)
    n = F.size("words")
    at = lambda i, k: F.get(F.col("words"), i + k)
    hashes = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[at(i, k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>"))
    a = a.select(
        "id",
        "stratum",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        hashes.alias("h"),
        *also,
    )
    # positions of windows found again, next to an equal one in sorted order; then the union of their words
    a = a.withColumn("again", F.when(F.size("h") > F.size(F.array_distinct("h")), F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda j, k: F.get(F.col("again"), j)["h"] == F.get(F.col("again"), j + k)["h"]
    twice = F.filter(F.transform("again", lambda x, j: F.when(F.coalesce(same(j, 1), F.lit(False)) | F.coalesce(F.when(j > 0, same(j, -1)), F.lit(False)), x["i"])), lambda i: i.isNotNull())
    a = a.withColumn("at", F.sort_array(twice))
    empty = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda s, i: F.struct((i + WINDOW).alias("end"), (s["n"] + (i + WINDOW - F.greatest(i, s["end"]))).alias("n"))
    return a.select(
        "id", "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.coalesce(F.aggregate("at", empty, step, lambda s: s["n"]), F.lit(0).cast("long")).alias("n_repeat_words"),
        "n_lines", *also,
    )


def measures() -> dict[str, Column]:
    """The rules' measures, large for bad texts; 0 where there is nothing to divide by."""
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return {"symbol_share": share("n_symbols", "n_words"), "dup_line_share": share("n_dup_lines", "n_lines"), "long_word": share("word_chars", "n_words")}


def binomial_tail(n: Column, k: Column, rate: float) -> Column:
    """P(Bin(n, rate) <= k) by the recurrence of the logarithms of its terms."""
    odds = rate / (1 - rate)
    first = n * F.log(F.lit(1 - rate))
    start = F.struct(first.alias("log"), F.exp(first).alias("sum"))

    def step(s: Column, i: Column) -> Column:
        log = s["log"] + F.log((n - i + 1) / i * odds)
        return F.struct(log.alias("log"), (s["sum"] + F.exp(log)).alias("sum"))

    terms = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.least(F.lit(1.0), F.aggregate(terms, start, step, lambda s: s["sum"]))


def certified_cutoffs(labelled: DataFrame, grids: dict[str, list[float]] = GRIDS, alpha: float = ALPHA, delta: float = DELTA, good_cost: float = GOOD_COST) -> DataFrame:
    """(stratum, rule, cutoff) from rows with stratum, good (boolean) and the measures."""
    level = lambda rule: F.size(F.filter(F.array(*map(F.lit, grids[rule])), lambda t: t <= F.col(rule)))  # noqa: E731  of the grid's cutoffs, how many reject it
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), level(r).alias("hit"), F.lit(len(g)).alias("size")) for r, g in grids.items()])).alias("x")
    counted = labelled.select("stratum", "good", each).groupBy("stratum", "x.rule", "x.size", "x.hit").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    # level j, from 1 the strictest, rejects what at least size - j + 1 cutoffs reject
    whole = counted.groupBy("stratum", "rule").agg(F.sum("good").alias("n"))
    steps = counted.withColumn("level", F.explode(F.sequence(F.lit(1), F.col("size"))))
    reject = F.col("hit") >= F.col("size") - F.col("level") + 1
    tests = steps.groupBy("stratum", "rule", "level").agg(F.sum(F.when(reject, F.col("good")).otherwise(0)).alias("k"), F.sum(F.when(reject, F.col("bad")).otherwise(0)).alias("caught"))
    tests = tests.join(whole, ["stratum", "rule"]).crossJoin(F.broadcast(whole.agg(F.countDistinct("stratum").alias("strata"))))  # one row
    rate = alpha / len(grids)
    fails = ~((F.col("k") <= rate * F.col("n")) & (F.when(F.col("k") <= rate * F.col("n"), binomial_tail(F.col("n"), F.col("k"), rate)) <= delta / (len(grids) * F.col("strata"))))
    before = Window.partitionBy("stratum", "rule").orderBy("level")
    good = tests.withColumn("failed", F.max(fails.cast("int")).over(before)).where("failed = 0")
    gain = F.col("caught") - good_cost * F.col("k")
    best = good.groupBy("stratum", "rule").agg(F.max_by("level", F.struct(gain, -F.col("level"))).alias("level"), F.max(gain).alias("gain")).where("gain > 0")
    lists = F.create_map(*[x for r, g in grids.items() for x in (F.lit(r), F.array(*map(F.lit, g)))])
    return best.select("stratum", "rule", F.get(lists[F.col("rule")], F.col("level") - 1).alias("cutoff"))


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str | None = "lang", alpha: float = ALPHA, delta: float = DELTA, good_cost: float = GOOD_COST, also: tuple[str, ...] = ()) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept), a row for each row of ``docs``.

    ``labels`` has the id and quality (1 good, 0 bad; null ignored; of repeated labels the best counts). A null text has no words
    and fails the base rules (fewer than 10 words, or over a fifth of them in 5-word windows found twice). ``alpha`` bounds the share of good documents
    rejected by cutoffs in each stratum, ``delta`` the chance that any bound fails, ``good_cost`` weighs a good document against bad ones. A null stratum is one
    of its own. Repeated and null ids are rows of their own; null ids have no label. Columns named in ``also``
    go through to the result (by names that the operator does not use itself); others are ignored.
    """
    base = saved(base_measures(docs, id_col, text_col, F.col(stratum_col) if stratum_col else None, also))
    rows = base.withColumns(measures()).withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    known = labels.where("quality is not null").groupBy(F.col(id_col).cast("long").alias("id")).agg((F.max("quality") == 1).alias("good"))
    cutoffs = certified_cutoffs(rows.where("not base_failed").join(known, "id"), GRIDS, alpha, delta, good_cost)
    wide = cutoffs.groupBy("stratum").pivot("rule", list(GRIDS)).agg(F.first("cutoff"))
    wide = wide.select("stratum", *[F.col(r).alias(f"cut_{r}") for r in GRIDS])
    judged = rows.join(wide, "stratum", "left")
    rejected = F.lit(False)
    for rule in GRIDS:
        rejected = rejected | F.coalesce(F.col(rule) >= F.col(f"cut_{rule}"), F.lit(False))
    return judged.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~rejected).alias("kept"), *also)


def oracle_sql(alpha: float = ALPHA, delta: float = DELTA, good_cost: float = GOOD_COST) -> str:
    """``quality_rules`` over documents and labels in DuckDB's SQL."""
    rules = " UNION ALL ".join(f"SELECT '{r}' AS rule, {k + 1} AS level, {c!r}::DOUBLE AS cutoff FROM (SELECT 1)" for r, g in GRIDS.items() for k, c in enumerate(g))
    ws = r"[\x20\x09-\x0D]+"
    return rf"""
        WITH grid AS ({rules}),
        d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(lang, 'und') AS stratum, coalesce(text, '') AS text FROM documents),
        w AS (SELECT *, list_filter(regexp_split_to_array(text, '{ws}'), lambda x: x <> '') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '{ws}', '', 'g') <> '') AS lines FROM d),
        win AS (SELECT n, i, words[i:i + 4] AS g FROM (SELECT n, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)),
        often AS (SELECT n, i FROM (SELECT n, i, count(*) OVER (PARTITION BY n, g) AS c FROM win) WHERE c > 1),
        rep AS (SELECT n, count(DISTINCT i + k) AS c FROM often, range(5) AS t(k) GROUP BY n),
        m AS (SELECT w.n, doc_id, stratum, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
                     (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
                     (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.c, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines
              FROM w LEFT JOIN rep ON rep.n = w.n),
        b AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
                     CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END AS symbol_share, CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS dup_line_share,
                     CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS long_word FROM m),
        known AS (SELECT doc_id, max(quality) = 1 AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
        lab AS (SELECT stratum, good, unnest([{", ".join(f"{{'rule': '{r}', 'v': {r}}}" for r in GRIDS)}]) AS x FROM b JOIN known USING (doc_id) WHERE NOT base_failed),
        t AS (SELECT lab.stratum, g.rule, g.level, g.cutoff, count(*) FILTER (good) AS n, count(*) FILTER (good AND x.v >= cutoff) AS k, count(*) FILTER (NOT good AND x.v >= cutoff) AS caught
              FROM lab JOIN grid g ON g.rule = lab.x.rule GROUP BY ALL),
        s AS (SELECT count(DISTINCT stratum) AS strata FROM t),
        p AS (SELECT t.*, coalesce(k <= {alpha / len(GRIDS)!r} * n AND (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({alpha / len(GRIDS)!r}) + (n - i) * ln(1 - {alpha / len(GRIDS)!r})))
              FROM (SELECT unnest(range(0, k + 1)) AS i)) <= {delta / len(GRIDS)!r} / strata, false) AS sure FROM t, s),
        ok AS (SELECT *, bool_and(sure) OVER (PARTITION BY stratum, rule ORDER BY level) AS certified FROM p),
        best AS (SELECT stratum, rule, cutoff, row_number() OVER (PARTITION BY stratum, rule ORDER BY caught - {good_cost!r} * k DESC, level) AS r FROM ok WHERE certified AND caught - {good_cost!r} * k > 0)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT base_failed AND NOT coalesce({" OR ".join(f"coalesce({r} >= (SELECT cutoff FROM best WHERE best.stratum = b.stratum AND rule = '{r}' AND r = 1), false)" for r in GRIDS)}, false) AS kept
        FROM b
    """
