"""Tables as immutable DataFrames: scans, upserts, deletes, retention, paging, diffs and unions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from ..functions import text as T
from ..session import saved


def where_equal(df: DataFrame, **wanted) -> DataFrame:
    """All columns equal the wanted values; None matches null."""
    return df.where(reduce(Column.__and__, [F.col(c).eqNullSafe(F.lit(v)) for c, v in wanted.items()], F.lit(True)))


def scan(df: DataFrame, where: dict | None = None, order_by: list[Column] | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    out = where_equal(df, **(where or {}))
    out = out.orderBy(*order_by) if order_by else out
    out = out.offset(offset) if offset else out
    return out.limit(limit) if limit is not None else out


def upsert(table: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """``rows`` (one per key) replace the columns they supply and append new keys; other columns keep their values, or are null in new rows."""
    changed = [c for c in rows.columns if c != key]
    new = rows.select(F.col(key).alias("_key"), F.lit(True).alias("_new"), *[F.col(c).alias(f"_{c}") for c in changed])
    both = table.join(new, F.col(key) == F.col("_key"), "full_outer")
    pick = lambda c: F.coalesce(key, "_key") if c == key else F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)) if c in changed else F.col(c)
    return both.select(*[pick(c).alias(c) for c in table.columns])


def delete_where(df: DataFrame, **wanted) -> DataFrame:
    """Without the rows that match; an empty condition is refused, None matches nothing."""
    if not wanted:
        raise ValueError("a delete needs a condition")
    hit = reduce(Column.__and__, [F.coalesce(F.col(c) == F.lit(v), F.lit(False)) for c, v in wanted.items()])
    return df.where(~hit)


def delete_keys(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return df.join(keys, on, "left_anti")


def append(df: DataFrame, rows: DataFrame, now: float) -> DataFrame:
    """New rows start with created_at = now and no recalls."""
    return df.unionByName(rows.withColumns({"created_at": F.lit(now), "recall_count": F.lit(0).cast("long")}), allowMissingColumns=True)


def append_once(df: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key is there already are dropped, and repeated new ones count once."""
    return df.unionByName(rows.dropDuplicates(key).join(df, key, "left_anti").select(df.columns))


def newest(df: DataFrame, n: int, by: str = "id", per: list[str] | None = None) -> DataFrame:
    """Retention: the n newest rows, of each group with ``per``."""
    if not per:
        return df.orderBy(F.desc(by)).limit(n)
    order = Window.partitionBy(*per).orderBy(F.desc(by))
    return df.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


def page(df: DataFrame, number: int, size: int, by: str = "id") -> DataFrame:
    """Pages from 1, newest first."""
    return df.orderBy(F.desc(by)).offset((number - 1) * size).limit(size)


def in_range(df: DataFrame, column: str, low=None, before=None) -> DataFrame:
    """The half-open range [low, before); null is outside as soon as one bound is given."""
    out = df.where(F.col(column) >= F.lit(low)) if low is not None else df
    return out.where(F.col(column) < F.lit(before)) if before is not None else out


def index_delta(current: DataFrame, desired: DataFrame, key: str = "id", values: tuple[str, ...] = ("text", "source")) -> DataFrame:
    """(key, action): the ids whose multisets of chunks differ; ``delete`` what is there only, ``add`` what is wanted only, ``replace`` the others."""
    # equal chunks are counted on both sides, so no id's texts meet in one row
    side = lambda df, name: df.groupBy(key, T.fingerprint(*values).alias("_f")).agg(F.count("*").alias(name))
    both = side(current, "old").join(side(desired, "new"), [key, "_f"], "full_outer").fillna(0, ["old", "new"])
    each = both.groupBy(key).agg(F.sum("old").alias("old"), F.sum("new").alias("new"), F.max(F.col("old") != F.col("new")).alias("differs")).where("differs")
    return each.select(key, F.when(F.col("new") == 0, "delete").when(F.col("old") == 0, "add").otherwise("replace").alias("action"))


def merged_snapshot(table: DataFrame, rows: DataFrame, removed: DataFrame, key: str = "id") -> DataFrame:
    """A graph or index save: tombstones go, changed rows replace whole rows, new ones come."""
    keep = table.join(rows.select(key), key, "left_anti").join(removed.select(key), key, "left_anti")
    return keep.unionByName(rows.join(removed.select(key), key, "left_anti"))


def changed_rows(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, change): added, removed or changed, by fingerprints of whole rows."""
    side = lambda df, name: df.select(key, T.fingerprint(*[c for c in df.columns if c != key]).alias(name))
    both = side(before, "old").join(side(after, "new"), key, "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))
    return both.select(key, F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed").alias("change"))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def new_texts(rows: DataFrame, known: DataFrame, scope: str = "user_id", content: str = "content") -> DataFrame:
    """Rows with text whose folded text is not yet known in its scope; of equal new ones the first by id stays."""
    key = T.folded(F.col(content))
    rows = rows.where(F.trim(content) != "").withColumn("_key", key)
    first = Window.partitionBy(scope, "_key").orderBy("id")
    rows = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    seen = known.select(scope, key.alias("_key")).distinct()
    return rows.join(seen, [scope, "_key"], "left_anti").drop("_key")


def by_ids(df: DataFrame, ids: list[int], key: str = "id") -> DataFrame:
    """Rows in the order of the ids asked for; missing ids are skipped."""
    wanted = df.sparkSession.createDataFrame([(i, n) for n, i in enumerate(ids)], f"{key} long, _pos int")
    return df.join(F.broadcast(wanted), key).orderBy("_pos").drop("_pos")  # as long as the caller's list


def tallies(df: DataFrame, group: str, status: str, names: list[str]) -> DataFrame:
    counts = [F.count_if(F.col(status) == n).alias(n) for n in names]
    return df.groupBy(group).agg(*counts, F.count("*").alias("total"))


def distinct_users(df: DataFrame, user: str = "user_id", others: str | None = None) -> DataFrame:
    """User ids, with those inside an array column, once each."""
    users = df.select(F.col(user).alias(user))
    if others:
        users = users.unionByName(df.select(F.explode(others).alias(user)))
    return users.where(F.col(user).isNotNull()).distinct()


def walked(df: DataFrame, group: str, order: list[str], column: str, name: str, kind: DataType, start, step: Callable) -> DataFrame:
    """``df`` with a column ``name``: (state, value) = step(state, row's ``column``), row after row of each group in order, from ``start``.

    For rules in which each row depends on all before it. Groups stream through their tasks sorted, so a task holds a batch and one state, not a group.
    """
    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, state = object(), start
        for batch in batches:
            out = []
            for key, x in zip(batch[group], batch[column], strict=True):
                if key != here and not (key != key and here != here):  # a missing key is a group of its own
                    here, state = key, start
                state, value = step(state, x)
                out.append(value)
            yield batch.assign(**{name: out})

    return df.repartition(group).sortWithinPartitions(group, *order).mapInPandas(run, StructType([*df.schema.fields, StructField(name, kind)]))


def ranges_in_order(df: DataFrame, order: list[str]) -> DataFrame:
    """The rows as a table dealt over ranges of ``order``, with the number of their range (_range): for running sums over a whole table, of which no task holds more than a range."""
    return saved(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))


def carried(ranged: DataFrame, value: Column, name: str, fold: Callable[[Column], Column]) -> DataFrame:
    """``ranged`` with what ``fold`` (sum or max) makes of ``value`` over all ranges before a row's own: a row per range meets in one task, the rows stay where they are."""
    each = ranged.groupBy("_range").agg(fold(value).alias("_v"))
    before = each.select("_range", fold(F.col("_v")).over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)).alias(name))
    return ranged.join(F.broadcast(before), "_range")  # as many rows as ranges


def interval_union(df: DataFrame, start: str = "start", end: str = "end", per: list[str] | None = None) -> DataFrame:
    """Overlapping and touching intervals as one; rows of an island are those between two gaps in the order of starts."""
    if per:
        order = Window.partitionBy(*per).orderBy(start, end)
        before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
        island = F.sum(F.when(before >= F.col(start), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
        return df.withColumn("_island", island).groupBy(*per, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")
    rows = carried(ranges_in_order(df.select(start, end), [start, end]), F.col(end), "_reach", F.max)
    order = Window.partitionBy("_range").orderBy(start, end)
    own = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(F.greatest(own, F.col("_reach")) >= F.col(start), 0).otherwise(1)
    marked = saved(rows.withColumn("_opens", opens).withColumn("_n", F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_reach"))
    numbered = carried(marked, F.col("_opens"), "_base", F.sum)
    return numbered.groupBy((F.coalesce("_base", F.lit(0)) + F.col("_n")).alias("_island")).agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def last_by_key(*sources: DataFrame, key: str = "id", order: list[str]) -> DataFrame:
    """The union of sources with the last row, in ``order``, of each key."""
    rows = reduce(DataFrame.unionByName, sources)
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("_row")).select("_row.*")


def audience(disclosed: str, public: Column, viewers: list[str]) -> Column:
    """Public, or every viewer is among those it was disclosed to."""
    return public | (F.size(F.array_except(F.array(*map(F.lit, viewers)), F.coalesce(F.col(disclosed), F.array().cast("array<string>")))) == 0)


def owned(owners: Column, attendees: Column, wanted: list[str] | None) -> Column:
    return F.lit(True) if wanted is None else F.arrays_overlap(owners, F.array(*map(F.lit, wanted))) | F.arrays_overlap(attendees, F.array(*map(F.lit, wanted)))


def record_visible(visibility: Column, witnesses: Column, location: Column, valid_until: Column, observer: str, at: str | None, now: float) -> Column:
    fresh = valid_until.isNull() | (valid_until > now)
    local = (visibility == "local") & (location == F.lit(at)) if at else F.lit(False)
    return fresh & (visibility.isin("public", "known") | F.coalesce(F.array_contains(witnesses, observer), F.lit(False)) | F.coalesce(local, F.lit(False)))


# ---- filters on documents, lists of participants and threads


def json_contains(column: str, wanted: dict[str, str | None]) -> Column:
    """A JSON object holds all wanted values (as text); None matches a missing key and a JSON null."""
    at = lambda key: F.get_json_object(column, f"$['{key}']")
    return reduce(Column.__and__, [at(k).eqNullSafe(F.lit(v)) for k, v in wanted.items()], F.lit(True))


def with_participant(df: DataFrame, user: str, owner: str = "user_id", participants: str = "participants") -> DataFrame:
    """Rows of a user, as owner or among the participants."""
    return df.where((F.col(owner) == user) | F.coalesce(F.array_contains(participants, user), F.lit(False)))


def open_threads(df: DataFrame, user: str) -> DataFrame:
    return df.where((F.col("user_id") == user) & (F.col("status") == "open"))


def occurred_in(df: DataFrame, low: float | None = None, before: float | None = None, column: str = "occurred_at") -> DataFrame:
    """Rows that occurred within [low, before); without a time a row is outside as soon as a bound is given."""
    return in_range(df, column, low, before)


# ---- listings and pages


def listed(df: DataFrame, position: str = "pos", deleted: str = "deleted") -> DataFrame:
    """What an index holds, without tombstones, in its order."""
    return df.where(~F.coalesce(F.col(deleted), F.lit(False))).orderBy(position)


def first_rows(df: DataFrame, n: int = 0, by: str = "id") -> DataFrame:
    """All rows by id, or the first n."""
    return df.orderBy(by).limit(n) if n > 0 else df.orderBy(by)


def with_totals(df: DataFrame, number: int, size: int, order: list[Column]) -> DataFrame:
    """One page, from 1, with the total of rows and of pages (rounded up) beside each row."""
    total = df.agg(F.count("*").alias("total"))
    rows = df.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)
    return rows.crossJoin(F.broadcast(total)).withColumn("pages", F.ceil(F.col("total") / size).cast("long"))  # one row


def ranked_page(rows: DataFrame, hits: DataFrame, number: int, size: int, low: float | None = None, before: float | None = None) -> DataFrame:
    """A page of the rows found (hits: row_id, relevance), within the dates, best first; total counts the rows that match."""
    found = in_range(rows, "created_at", low, before).join(hits.select(F.col("row_id").alias("id"), "relevance"), "id")
    return with_totals(found, number, size, [F.desc("relevance"), F.asc("id")])


def record_page(rows: DataFrame, number: int = 1, size: int = 25, *, user: str | None = None, text: str | None = None, low: float | None = None, before: float | None = None, hits: DataFrame | None = None, content: str = "content") -> DataFrame:
    """Records as a reader asks for them: by user, dates and a query; found ones by relevance (``hits``), else those that hold the text, else all, newest first."""
    own = in_range(rows if user is None else rows.where(F.col("user_id") == user), "created_at", low, before)
    if hits is not None:
        return ranked_page(own, hits, number, size)
    if text:
        own = own.where(T.substring_hits(F.col(content), text) > 0)
    return with_totals(own, number, size, [F.desc("id")])


def user_records(df: DataFrame, part: str, user: str = "user_id") -> DataFrame:
    """Records whose user id holds a part, case aside."""
    return df.where(F.lower(user).contains(part.lower()))


def known_users(tables: list[DataFrame], user: str = "user_id") -> DataFrame:
    """User ids over all tables, once each, in order."""
    return reduce(DataFrame.unionByName, [t.select(user) for t in tables]).where(F.col(user).isNotNull()).distinct().orderBy(user)


def log_users(log: DataFrame, user: str = "user_id", participants: str = "participants") -> DataFrame:
    """Everyone that an extraction log names, as owner or participant."""
    return distinct_users(log, user, participants)


def ordered_union(*columns: Column) -> Column:
    """The items of lists, each once, where it comes first; nulls and null lists are left out."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.filter(F.concat(*[F.coalesce(c, none) for c in columns]), lambda x: x.isNotNull()))


def reset(df: DataFrame) -> DataFrame:
    """The table without rows."""
    return df.limit(0)


def unseen_deltas(deltas: DataFrame, applied: DataFrame, key: str = "delta_id") -> DataFrame:
    """Pending changes that an index has not seen, each once, in order."""
    return deltas.dropDuplicates([key]).join(applied.select(key), key, "left_anti").orderBy(key)
