"""Calendars: weekly routines, occurrences in windows, ranking, and the changes of a calendar."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import intervals as N
from . import memory as M


def weekly_occurrences(rules: DataFrame, start: str, before: str) -> DataFrame:
    """Rules (id, weekdays 0 = Monday, start_local HH:mm, minutes, timezone) as (id, day, start, end) that overlap [start, before), UTC timestamps.

    Local days from one day before the range are tried, so an occurrence across midnight is found; the zone decides daylight saving.
    """
    low, high = F.lit(start).cast("timestamp"), F.lit(before).cast("timestamp")
    days = F.sequence(F.date_sub(F.to_date(low), 2), F.date_add(F.to_date(high), 1))
    each = rules.withColumn("day", F.explode(days)).where(F.array_contains("weekdays", F.weekday("day")))
    begin = F.to_utc_timestamp(F.to_timestamp(F.concat_ws(" ", F.col("day").cast("string"), "start_local"), "yyyy-MM-dd HH:mm"), F.col("timezone"))
    each = each.withColumn("start", begin).withColumn("end", F.col("start") + F.make_dt_interval(mins=F.col("minutes")))
    return each.where((F.col("start") < high) & (F.col("end") > low)).select("id", "day", "start", "end")


def occurrences(single: DataFrame, weekly: DataFrame, start: str, before: str) -> DataFrame:
    """One-off events (id, start, end) in the range with the expanded routines; of equal occurrence ids the last in (start, end) stays."""
    low, high = F.lit(start).cast("timestamp"), F.lit(before).cast("timestamp")
    one = single.where(T.overlaps(F.col("start"), F.col("end"), low, high)).select(F.col("id").cast("string").alias("occurrence"), "start", "end")
    many = weekly_occurrences(weekly, start, before).select(F.concat(F.col("id").cast("string"), F.lit("@"), F.col("day").cast("string")).alias("occurrence"), "start", "end")
    rows = one.unionByName(many)
    return rows.groupBy("occurrence").agg(F.max_by(F.struct("start", "end"), F.struct("start", "end")).alias("x")).select("occurrence", "x.start", "x.end")


def calendar_ranked(events: DataFrame, now: float, limit: int, *, queried: bool = True, weight: float = 1.0, temporal_weight: float = 1.0) -> DataFrame:
    """Events (id, start, end epoch seconds, lexical, semantic, temporal) by relevance and nearness; without a query in time order."""
    order = [F.asc("start"), F.asc("end"), F.asc("id")]
    if queried:
        ongoing = (F.col("start") <= now) & (F.col("end") > now)
        near = F.when(ongoing, 2.0).otherwise(1 / (1 + F.greatest(F.lit(0.0), F.col("start") - now) / 86_400))
        relevant = F.col("lexical") * weight + F.col("semantic") + temporal_weight * F.col("temporal")
        events = events.where(relevant > 0).withColumn("score", 10 * relevant + near)
        order = [F.desc("score"), *order]
    else:
        events = events.withColumn("score", F.lit(0.0))
    best = events.orderBy(*order).limit(limit)  # the best of each task meet, not all events
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def clipped_windows(ranges: DataFrame, now: float, most_days: int = 400, low: float | None = None, before: float | None = None) -> DataFrame:
    """Ranges (start, end) cut to ``most_days`` on either side of now, then to the bounds; empty ones go."""
    span = most_days * 86_400.0
    start, end = F.greatest("start", F.lit(now - span), F.lit(low)), F.least("end", F.lit(now + span), F.lit(before))
    return ranges.select(start.alias("start"), end.alias("end")).where("start < end")


def active_routine(occurrences_: DataFrame, instants: DataFrame) -> DataFrame:
    """(actor, instant, routine): of the routines (actor, start, end, priority, routine) that cover an instant the one of highest priority, then the latest start; by actor and cell of time."""
    hit = N.covered(instants.select("actor", "instant"), occurrences_.select("actor", "start", "end", "priority", "routine"), "instant", "start", "end", ["actor"])
    return hit.groupBy("actor", "instant").agg(F.max_by("routine", F.struct("priority", "start", "routine")).alias("routine"))


def boundaries(occurrences_: DataFrame, low, high) -> DataFrame:
    """Distinct begins and ends strictly inside an interval, by actor."""
    return occurrences_.select("actor", F.explode(F.array("start", "end")).alias("instant")).where((F.col("instant") > low) & (F.col("instant") < high)).distinct()


def day_bounds(day: str, timezone: str) -> tuple:
    """The half-open UTC range of a local day."""
    start = F.to_utc_timestamp(F.to_timestamp(F.lit(day)), timezone)
    return start, F.to_utc_timestamp(F.to_timestamp(F.date_add(F.to_date(F.lit(day)), 1)), timezone)


SELF = "self"


def created_events(calendar: DataFrame, new: DataFrame, now: float, source: str = "manual") -> DataFrame:
    """The calendar with new events (id, user_id, title, ..): active, as important as can be unless they say, normalised lists; invalid ones are left out."""
    rows = M.normalised_events(new).where("valid").drop("valid")
    given = {"user_id": F.lit(SELF), "importance": F.lit(1.0), "source": F.lit(source), "source_message_ids": F.array().cast("array<bigint>")}
    rows = rows.withColumns({c: F.coalesce(c, v) if c in rows.columns else v for c, v in given.items()})
    rows = rows.withColumns({"created_at": F.lit(now), "updated_at": F.lit(now), "status": F.lit("active"), "recall_count": F.lit(0).cast("long")})
    return calendar.unionByName(rows.select([c for c in calendar.columns if c in rows.columns]), allowMissingColumns=True)


def changed_events(calendar: DataFrame, changes: DataFrame, now: float) -> DataFrame:
    """The calendar after changes (id, kind: update or cancel, source_message_ids, and columns to set; null: as it was), one per event; sources join in order."""
    skipped = ("id", "kind", "source_message_ids")
    values = [c for c in changes.columns if c not in skipped and c in calendar.columns]
    c = changes.select("id", F.col("kind").alias("_kind"), F.col("source_message_ids").alias("_s"), *[F.col(v).alias(f"_{v}") for v in values])
    both, hit = calendar.join(c, "id", "left"), F.col("_kind").isNotNull()
    new = {v: F.when(F.col("_kind") == "update", F.coalesce(f"_{v}", v)).otherwise(F.col(v)) for v in values}
    new["status"] = F.when(F.col("_kind") == "cancel", "cancelled").otherwise(new.get("status", F.col("status")))
    new["source_message_ids"] = F.when(hit, F.array_distinct(F.concat("source_message_ids", F.coalesce("_s", F.array().cast("array<bigint>"))))).otherwise(F.col("source_message_ids"))
    new["updated_at"] = F.when(hit, F.lit(now)).otherwise(F.col("updated_at"))
    return both.withColumns(new).select(calendar.columns)


def deferred_effects(calendar: DataFrame, effects: DataFrame, now: float) -> DataFrame:
    """The calendar after the effects of one reply (effect, event_id, owner_id, source_message_id, and columns): creations with an owner, and updates and cancellations of events
    of the owner named; others change nothing. Of several effects on one event the last by message counts."""
    made = effects.where("effect = 'calendar_create' and trim(owner_id) <> ''").withColumns({"id": F.col("event_id"), "user_id": F.col("owner_id"), "source": F.lit("model_tool"), "source_message_ids": F.array("source_message_id")})
    owners = calendar.select(F.col("id").alias("event_id"), F.coalesce("user_id", F.lit(SELF)).alias("_owner"))
    own = effects.where("effect in ('calendar_update', 'calendar_cancel')").join(owners, "event_id").where((F.trim(F.coalesce("owner_id", F.lit(""))) == "") | (F.col("owner_id") == F.col("_owner")))
    last = own.groupBy("event_id").agg(F.max_by(F.struct(*own.columns), "source_message_id").alias("x")).select("x.*")
    changes = last.select(F.col("event_id").alias("id"), F.expr("substring(effect, 10)").alias("kind"), F.array("source_message_id").alias("source_message_ids"), *[c for c in effects.columns if c in calendar.columns and c not in ("id", "source_message_ids", "status", "user_id", "kind")])
    return created_events(changed_events(calendar, changes, now), made.drop("effect", "event_id", "owner_id", "source_message_id"), now, "model_tool")


def permitted_updates(updates: DataFrame, calendar: DataFrame, speakers: DataFrame) -> DataFrame:
    """Extracted calendar updates (event_id, action, user_id, owner_id) that may apply: new events of the self, the user or one who speaks in the chat; changes by an owner or attendee only."""
    who = F.coalesce("owner_id", F.lit(SELF))
    heard = speakers.select(F.col("user_id").alias("_who")).distinct()
    new = updates.where("action = 'create'").withColumn("_who", who)
    new = new.where((F.col("_who") == SELF) | (F.col("_who") == F.col("user_id"))).unionByName(new.where((F.col("_who") != SELF) & (F.col("_who") != F.col("user_id"))).join(heard, "_who", "left_semi")).drop("_who")
    own = calendar.select(F.col("id").alias("event_id"), F.col("user_id").alias("_o"), F.col("attendees").alias("_a"))
    old = updates.where("action <> 'create'").join(own, "event_id")
    old = old.where((F.col("_o") == F.col("user_id")) | F.coalesce(F.array_contains("_a", F.col("user_id")), F.lit(False)))
    return new.select(updates.columns).unionByName(old.select(updates.columns))


def recalled_events(events: DataFrame, users: list[str], now: float, limit: int, queried: bool = True) -> DataFrame:
    """The calendar's answer to users (one, or a group, once): active events of theirs and of the self, or that they attend, ranked, with a line to read."""
    wanted = [SELF, *users]
    mine = F.col("user_id").isin(wanted) | F.coalesce(F.arrays_overlap("attendees", F.array(*map(F.lit, wanted))), F.lit(False))
    best = calendar_ranked(events.where(mine & (F.col("status") != "cancelled")), now, limit, queried=queried)
    stamp = lambda c: F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd HH:mm")
    line = F.concat(F.col("title"), F.lit(" ("), stamp("start"), F.lit(" - "), stamp("end"), F.lit(")"), F.when(F.trim(F.coalesce("location", F.lit(""))) != "", F.concat(F.lit(" at "), F.col("location"))).otherwise(""))
    return best.withColumn("line", line)


def calendar_page(events: DataFrame, now: float, number: int, size: int, cap: int, queried: bool = True) -> DataFrame:
    """A page of the ranked calendar; no more than ``cap`` events are ranked, as a reader's page asks for."""
    ranked = calendar_ranked(events, now, cap, queried=queried)
    return ranked.where((F.col("rank") > (number - 1) * size) & (F.col("rank") <= number * size))
