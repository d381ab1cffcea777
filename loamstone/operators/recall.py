"""Structured recall: relevance signals, ageing, repair, and top k with one slot for sticky rows."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType

from ..functions import scoring as S
from ..session import saved
from . import intervals as N
from . import tables as B

STICKY, E_FOLD = 0.95, 3 * S.DAY


def keyword_relevance(query: str, keywords: Column) -> Column:
    low = query.lower()
    return F.exists(keywords, lambda k: (k != "") & F.lit(low).contains(F.lower(k))).cast("double")


def followup_relevance(not_before: Column, last_recalled: Column, now: float, cooldown: float = S.DAY, value: float = 0.7) -> Column:
    due = (not_before <= now) & (F.coalesce(last_recalled, F.lit(0.0)) <= now - cooldown)
    return F.when(due, value).otherwise(0.0)


def temporal_relevance(rows: DataFrame, ranges: DataFrame, start: str = "occurred_at", end: str | None = None, per: list[str] | None = None) -> DataFrame:
    """(per.., id, temporal): the best confidence times weight among the ranges that a row overlaps, of one query or of each query of ``per``; joined by cells of time.

    Of a query's ranges of one worth those that overlap are one for the join (``intervals.fused``), so a row meets few of them however many cover it.
    """
    own = rows.where(F.col(start).isNotNull()).select("id", F.col(start).alias("_from"), (F.col(end) if end else F.lit(None).cast("double")).alias("_until"))
    asked = ranges.select(*(per or []), F.col("start").alias("_low"), F.col("end").alias("_high"), (F.col("confidence") * F.col("query_weight")).alias("_worth"))
    whole = saved(N.fused(asked, "_low", "_high", [*(per or []), "_worth"]))
    found = N.overlapping(own.repartition("id"), whole, "_from", "_until", "_low", "_high")
    odd = own.where("_until < _from")  # lies in the one range that holds both its ends, not in what overlaps
    if not odd.isEmpty():
        found = found.join(odd.select("id"), "id", "left_anti").unionByName(N.overlapping(odd, asked, "_from", "_until", "_low", "_high"))
    return found.groupBy(*(per or []), "id").agg(F.max("_worth").alias("temporal"))


def scored(rows: DataFrame, semantic: DataFrame, temporal: DataFrame | None, now: float, *, temporal_weight: float = 1.0, e_fold: float = E_FOLD, sticky: float | None = STICKY, impact: Column | None = None) -> DataFrame:
    """Candidates (relevant, temporally matched or sticky rows) with intrinsic, effective, combined and final score.

    rows: id, importance, recall_count, created_at and, where it exists, occurred_at. semantic: (id, semantic). temporal: (id, temporal).
    """
    out = rows.join(semantic, "id", "left")
    out = out.join(temporal, "id", "left") if temporal is not None else out.withColumn("temporal", F.lit(None).cast("double"))
    is_sticky = F.lit(False) if sticky is None else F.col("importance") >= sticky
    out = out.withColumn("is_sticky", is_sticky).where("semantic is not null or temporal is not null or is_sticky")
    occurred = F.col("occurred_at") if "occurred_at" in rows.columns else None
    out = out.fillna({"semantic": 0.0, "temporal": 0.0})
    out = out.withColumn("intrinsic", S.intrinsic_score(F.col("importance"), impact))
    out = out.withColumn("effective", S.decay_score(F.col("importance"), F.col("recall_count"), S.age_seconds(now, F.col("created_at"), occurred), e_fold, impact))
    out = out.withColumn("combined", S.either(F.col("semantic"), F.col("temporal"), temporal_weight))
    return out.withColumn("score", S.repaired_score(F.col("intrinsic"), F.col("effective"), F.col("combined")))


def _order() -> list[Column]:
    return [F.desc("score"), F.desc("combined"), F.desc("temporal"), F.desc("semantic"), F.asc("id")]


def sticky_top(candidates: DataFrame, limit: int, per: list[str] | None = None) -> DataFrame:
    """The best ``limit`` rows; if any is sticky (and limit is over 1), the best sticky one and the best limit - 1 of the others, even if those are fewer."""
    keys = per or []
    groups = Window.partitionBy(*keys)
    if limit < 2:
        return candidates.withColumn("rank", F.row_number().over(groups.orderBy(*_order()))).where(F.col("rank") <= limit)
    sticky_order = [*_order()[:-1], F.desc("effective"), F.asc("id")]
    # plain limits on row numbers, which each task applies before the shuffle; what is left is at most limit + 1 rows of a group
    sticky = candidates.where("is_sticky").withColumn("_n", F.row_number().over(groups.orderBy(*sticky_order))).where("_n <= 1")
    others = candidates.where("not is_sticky").withColumn("_n", F.row_number().over(groups.orderBy(*_order()))).where(F.col("_n") <= limit)
    out = others.unionByName(sticky).withColumn("_any", F.max("is_sticky").over(groups))
    kept = out.where(F.col("is_sticky") | ~F.col("_any") | (F.col("_n") <= limit - 1))
    return kept.withColumn("rank", F.row_number().over(groups.orderBy(*_order()))).drop("_any", "_n")


def recalled(rows: DataFrame, surfaced: DataFrame, now: float) -> DataFrame:
    """Telemetry of a recall: surfaced ids count one more and remember when."""
    hit = rows.join(surfaced.select("id", F.lit(True).alias("_hit")).distinct(), "id", "left")
    return hit.withColumns({
        "recall_count": F.col("recall_count") + F.when(F.col("_hit"), 1).otherwise(0),
        "last_recalled": F.when(F.col("_hit"), F.lit(now)).otherwise(F.col("last_recalled")),
    }).drop("_hit").select(rows.columns)


def reranked(items: DataFrame, weights: dict[str, float] | None = None, per: list[str] | None = None) -> DataFrame:
    """Scores over the best of their memory, times its weight; equal scores keep the input order (input_pos).

    ``per`` names the columns of a query; without it the items are the answer to one query.
    """
    good = F.when((F.col("score") > 0) & (F.col("score") < float("inf")), F.col("score")).otherwise(0.0)
    best = F.max(good).over(Window.partitionBy(*(per or []), "memory"))
    weight = F.coalesce(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("memory")], F.lit(1.0)) if weights else F.lit(1.0)
    share = F.when(best > 0, good / best).otherwise(0.0) * weight
    return items.withColumn("reranked", share).withColumn("position", F.row_number().over(Window.partitionBy(*(per or [F.lit(0)])).orderBy(F.desc(share), "input_pos")))


def budget_prefix(items: DataFrame, budget: int, order: list[Column], tokens: str = "tokens", per: list[str] | None = None) -> DataFrame:
    """The longest prefix whose tokens fit: the walk stops at the first item that does not.

    Without ``per`` the items are the answer to one query: what costs a token or more is cut to the first ``budget`` items before they meet in one task.
    """
    if not per:
        items = items.where(F.col(tokens) <= 0).unionByName(items.where(F.col(tokens) > 0).orderBy(*order).limit(budget + 1))
    run = Window.partitionBy(*(per or [F.lit(0)])).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return items.withColumn("used_tokens", F.sum(tokens).over(run)).where(F.col("used_tokens") <= budget)


def budget_greedy(items: DataFrame, budget: int, group: str, order: str | list[str], tokens: str = "tokens") -> DataFrame:
    """Greedy with skipping: an item that does not fit is passed over and later ones may still fit. A group's items stream by in order."""

    def step(used: int, n: int) -> tuple[int, bool]:
        fits = bool(used + n <= budget)
        return used + n * fits, fits

    kept = B.walked(items.where(F.col(tokens) <= budget), group, [order] if isinstance(order, str) else order, tokens, "_fits", BooleanType(), 0, step)
    return kept.where("_fits").drop("_fits")


def budget_rendered(items: DataFrame, budget: int, order: list[str], per: str = "query_id", *, titles: dict[str, str] | None = None, section: str = "section", under: str | None = None, text: str = "text") -> DataFrame:
    """The items of each query that fit its budget of tokens as they are rendered together, with ``used_tokens`` after each.

    Items come in ``order``; one that does not fit is passed over and later ones may still fit. The cost is that of the whole text: sections under their titles (``## title``), a blank
    line between them, in a section the items without ``under`` and then those of each ``under`` below its name, and a line (``- text``) for each item. So a heading is paid by the
    first item that needs it. Blank texts cost nothing and are left out. The state of the walk is the headings that are open and the length so far.
    """
    names = F.create_map(*[F.lit(x) for kv in titles.items() for x in kv]) if titles else None
    title = F.coalesce(names[F.col(section)], F.col(section)) if titles else F.col(section)
    body = F.length(F.trim(F.coalesce(text, F.lit(""))))
    needs = F.to_json(F.struct(F.col(section).alias("s"), (F.length(title) + 3).alias("t"), (F.col(under) if under else F.lit(None).cast("string")).alias("u"), (body + 2).alias("n")))
    own = items.where(body > 0).withColumn("_needs", needs)

    def step(state: tuple[frozenset, int], needs: str) -> tuple[tuple[frozenset, int], int | None]:
        open_, length = state
        need = json.loads(needs)
        head, sub = need["s"], (need["s"], need["u"]) if "u" in need else None
        more, new = need["n"] + 1, open_  # a line and the break before it
        if head not in open_:
            more, new = more + need["t"] + (2 if open_ else 0), new | {head}
        if sub is not None and sub not in open_:
            more, new = more + len(need["u"]) + 2, new | {sub}
        used = -(-(length + more) // 4)
        return ((new, length + more), used) if used <= budget else (state, None)

    out = B.walked(own, per, order, "_needs", "used_tokens", LongType(), (frozenset(), 0), step)
    return out.where(F.col("used_tokens").isNotNull()).drop("_needs")


def rendered(items: DataFrame, order: list[str], per: str = "query_id", *, titles: dict[str, str] | None = None, section: str = "section", under: str | None = None, text: str = "text") -> DataFrame:
    """(per, prompt): the text of chosen items as ``budget_rendered`` counts it: sections and names in the order of their first item, items in order."""
    names = F.create_map(*[F.lit(x) for kv in titles.items() for x in kv]) if titles else None
    title = F.coalesce(names[F.col(section)], F.col(section)) if titles else F.col(section)
    own = items.where(F.trim(F.coalesce(text, F.lit(""))) != "").withColumn("_u", F.col(under) if under else F.lit(None).cast("string")).withColumn("_at", F.struct(*order))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", F.concat(F.lit("- "), F.trim(text)).alias("line")))), lambda x: x["line"]), "\n")  # a prompt is as long as its budget
    blocks = own.groupBy(per, F.col(section).alias("_s"), title.alias("_t"), "_u").agg(F.min("_at").alias("_at"), lines.alias("body"))
    body = F.when(F.col("_u").isNull(), F.col("body")).otherwise(F.concat("_u", F.lit(":\n"), "body"))
    joined = lambda by, sep: F.array_join(F.transform(F.array_sort(F.collect_list(by)), lambda x: x["body"]), sep)
    sections = blocks.groupBy(per, "_s", "_t").agg(F.min("_at").alias("_at"), joined(F.struct(F.col("_u").isNotNull().alias("k"), "_at", body.alias("body")), "\n").alias("body"))
    return sections.groupBy(per).agg(joined(F.struct("_at", F.concat(F.lit("## "), "_t", F.lit("\n"), "body").alias("body")), "\n\n").alias("prompt"))


def min_max(df: DataFrame, column: str, out: str, per: list[str] | None = None) -> DataFrame:
    if per:
        groups = Window.partitionBy(*per)
        low, high = F.min(column).over(groups), F.max(column).over(groups)
    else:
        df = df.crossJoin(F.broadcast(df.agg(F.min(column).alias("_low"), F.max(column).alias("_high"))))  # one row
        low, high = F.col("_low"), F.col("_high")
    return df.withColumn(out, (F.col(column) - low) / F.when(high > low, high - low).otherwise(F.lit(1.0))).drop("_low", "_high")


def checked_order(candidates: DataFrame, answer: DataFrame) -> DataFrame:
    """Candidates in the order of a reranker's answer (id, position); an id that is unknown or given twice is an error."""
    bad = answer.groupBy("id").agg(F.count("*").alias("n")).join(candidates.select("id", F.lit(True).alias("known")), "id", "left").where("n > 1 or known is null")
    if not bad.isEmpty():
        raise ValueError("a reranker may neither repeat candidates nor add any")
    return candidates.join(answer.select("id", "position"), "id").orderBy("position")
