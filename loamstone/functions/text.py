"""Text, time and vector expressions; everything stays in column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN_SEPARATORS = r"[^\p{L}\p{N}_]+"


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), TOKEN_SEPARATORS), "")


def slugify(text: Column) -> Column:
    """Lower case, runs of other signs than a-z and 0-9 as one hyphen, none at the ends; ``entity`` if nothing is left."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(slug == "", F.lit("entity")).otherwise(slug)


def safe_name(name: Column) -> Column:
    """Letters, digits, underscores and hyphens only, none of the last two at the ends; null if nothing is left."""
    kept = F.regexp_replace(F.regexp_replace(name, "[^a-zA-Z0-9_-]+", ""), "^[_-]+|[_-]+$", "")
    return F.when(kept == "", None).otherwise(kept)


def folded(text: Column) -> Column:
    """The key of case-insensitive equality: trimmed and lower-cased."""
    return F.lower(F.trim(text))


def token_count(text: Column) -> Column:
    """A quarter of the characters, rounded up, where no tokenizer is wanted."""
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / 4).cast("long")


def clip(value: Column, low: float = 0.0, high: float = 1.0, bad: float = 0.5) -> Column:
    """``value`` as a number within [low, high]; what is no number counts as ``bad``."""
    x = value.try_cast("double")
    return F.greatest(F.lit(low), F.least(F.lit(high), F.when(x.isNull() | F.isnan(x), F.lit(bad)).otherwise(x)))


def fingerprint(*columns: str) -> Column:
    """SHA-256 of the columns as JSON."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def decoded_ids(text: Column) -> Column:
    return F.coalesce(F.from_json(text, "array<bigint>"), F.array().cast("array<bigint>"))


def aliases(raw: Column) -> Column:
    """A JSON list, else parts between commas; trimmed, without blanks."""
    listed = F.when(F.trim(raw).startswith("["), F.from_json(raw, "array<string>"))
    parts = F.coalesce(listed, F.split(raw, ","))
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def joined_names(name: Column, others: Column, most: int = 6) -> Column:
    """A name and its distinct aliases as one text."""
    return F.array_join(F.slice(F.array_distinct(F.filter(F.concat(F.array(name), others), lambda x: x != "")), 1, most), ". ")


def substring_hits(text: Column, query: str) -> Column:
    """How often a query occurs in a text, case aside."""
    low, q = F.lower(F.coalesce(text, F.lit(""))), query.lower()
    return ((F.length(low) - F.length(F.replace(low, F.lit(q), F.lit("")))) / len(q)).cast("long") if q else F.lit(0).cast("long")


def mentions(text: Column, label: Column) -> Column:
    """Whether a label of three characters or more stands in a text as whole words, case aside."""
    word = r"[\p{L}\p{N}_]"
    quoted = F.concat(F.lit(rf"(?<!{word})\Q"), F.lower(F.trim(label)), F.lit(rf"\E(?!{word})"))
    return (F.length(F.trim(label)) >= 3) & F.rlike(F.lower(text), quoted)


def age_label(seconds: Column) -> Column:
    """just now, minutes, hours, days, weeks (under five), months (under twelve), years; counts are rounded down."""
    n = lambda by: F.floor(seconds / by).cast("long")
    say = lambda count, unit: F.concat(count.cast("string"), F.when(count == 1, F.lit(f" {unit} ago")).otherwise(F.lit(f" {unit}s ago")))
    day = 86_400
    return (
        F.when(seconds < 60, F.lit("just now")).when(seconds < 3600, say(n(60), "minute")).when(seconds < day, say(n(3600), "hour"))
        .when(seconds < 7 * day, say(n(day), "day")).when(n(7 * day) < 5, say(n(7 * day), "week"))
        .when(n(30 * day) < 12, say(F.greatest(F.lit(1), n(30 * day)), "month")).otherwise(say(F.greatest(F.lit(1), n(365 * day)), "year"))
    )


def months_between(start: Column, end: Column) -> Column:
    """Whole calendar months from start to end: a month counts once its day and time of day are reached."""
    months = (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)
    rest = lambda t: F.struct(F.dayofmonth(t), F.date_format(t, "HH:mm:ss.SSSSSS"))
    return (months - F.when((months > 0) & (rest(end) < rest(start)), 1).when((months < 0) & (rest(end) > rest(start)), -1).otherwise(0)).cast("long")


def grain_range(moment: Column, grain: str) -> tuple[Column, Column]:
    """The half-open range of the year, quarter, month, week (from Monday), day, hour, minute or second that holds a moment."""
    start = F.date_trunc(grain, moment)
    steps = {"year": "1 year", "quarter": "3 months", "month": "1 month", "week": "7 days", "day": "1 day", "hour": "1 hour", "minute": "1 minute", "second": "1 second"}
    return start, start + F.expr(f"interval {steps[grain]}")


def overlaps(start: Column, end: Column, low: Column, high: Column) -> Column:
    """Half-open overlap; a null end is a point."""
    return F.when(end.isNull(), (low <= start) & (start < high)).otherwise((start < high) & (end > low))


def parsed_time(value: Column) -> Column:
    """A UTC timestamp from epoch seconds, ISO 8601 (without an offset: UTC) or a written date; null if it is none of these."""
    text = F.trim(value)
    seconds = text.try_cast("double")
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}(?:[T ].*)?$"), text.try_cast("timestamp"))
    # a pattern is tried where the text has its shape only, since names of days are no part of what a parser takes
    bare = F.regexp_replace(text, r" \([A-Za-z]{3}\) ", " ")
    written = F.coalesce(
        F.when(text.rlike(r"^\d{4}/\d{2}/\d{2} "), F.try_to_timestamp(bare, F.lit("yyyy/MM/dd HH:mm"))),
        F.when(text.rlike(r"(?i)^\d{1,2}:\d{2} [ap]m on "), F.try_to_timestamp(F.regexp_replace(F.upper(text), "(?i) on ", " "), F.lit("h:mm a d MMMM, yyyy"))),
    )
    return F.when(seconds.isNotNull(), F.timestamp_micros((seconds * 1e6).cast("long"))).otherwise(F.coalesce(iso, written))


def coerced_time(value: Column, now: float) -> Column:
    """``parsed_time``, and now where there is none."""
    return F.coalesce(parsed_time(value), F.timestamp_micros(F.lit(int(now * 1e6))))


def epoch(moment: Column) -> Column:
    return F.unix_micros(moment.cast("timestamp")) / 1e6


# ---- vectors and emotion maps


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """A vector of length 1; zero stays zero."""
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x.cast("double") / F.when(norm > 0, norm).otherwise(F.lit(1.0)))


def cosine(a: Column, b: Column) -> Column:
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(F.lit(0.0))


def emotion(values: Column, axes: list[str]) -> Column:
    """Known axes only, within [0, 1], without numbers that are none."""
    known = F.map_filter(values, lambda k, v: k.isin(axes) & v.isNotNull() & ~F.isnan(v))
    return F.transform_values(known, lambda _, v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)))


def _squares(values: Column) -> Column:
    return F.aggregate(F.map_values(values), F.lit(0.0), lambda s, x: s + x * x)


def emotional_impact(values: Column) -> Column:
    return F.coalesce(F.least(F.lit(1.0), F.sqrt(_squares(values))), F.lit(0.0))


def emotion_similarity(a: Column, b: Column) -> Column:
    """Cosine over axes, a missing axis is 0, within [0, 1]; 0 if either is all zero."""
    both = F.aggregate(F.map_keys(a), F.lit(0.0), lambda s, k: s + a[k] * F.coalesce(b[k], F.lit(0.0)))
    norms = F.sqrt(_squares(a)) * F.sqrt(_squares(b))
    return F.coalesce(F.when(norms > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), both / norms))), F.lit(0.0))


def shifted_dims(dims: Column, deltas: Column) -> Column:
    """Signed deltas added to the dims there are, within [-1, 1]."""
    return F.transform_values(dims, lambda k, v: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v + F.coalesce(deltas[k], F.lit(0.0)))))
