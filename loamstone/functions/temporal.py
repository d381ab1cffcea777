"""Time expressions in texts as half-open UTC ranges with confidences. The reference time is a parameter."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86_400, "week": 604_800}
# Phrases of each language with the grain and the steps from now.
PHRASES = {
    "en": {
        "the day before yesterday": ("day", -2), "yesterday": ("day", -1), "today": ("day", 0), "tomorrow": ("day", 1), "the day after tomorrow": ("day", 2),
        "last week": ("week", -1), "this week": ("week", 0), "next week": ("week", 1), "last month": ("month", -1), "this month": ("month", 0), "next month": ("month", 1),
        "last year": ("year", -1), "this year": ("year", 0), "next year": ("year", 1),
    },
    "de": {
        "vorgestern": ("day", -2), "gestern": ("day", -1), "heute": ("day", 0), "morgen": ("day", 1), "übermorgen": ("day", 2),
        "letzte woche": ("week", -1), "diese woche": ("week", 0), "nächste woche": ("week", 1), "letzten monat": ("month", -1), "diesen monat": ("month", 0), "nächsten monat": ("month", 1),
        "letztes jahr": ("year", -1), "dieses jahr": ("year", 0), "nächstes jahr": ("year", 1),
    },
    "fr": {
        "avant-hier": ("day", -2), "hier": ("day", -1), "aujourd'hui": ("day", 0), "demain": ("day", 1), "après-demain": ("day", 2),
        "la semaine dernière": ("week", -1), "cette semaine": ("week", 0), "la semaine prochaine": ("week", 1), "le mois dernier": ("month", -1), "ce mois-ci": ("month", 0), "le mois prochain": ("month", 1),
        "l'année dernière": ("year", -1), "cette année": ("year", 0), "l'année prochaine": ("year", 1),
    },
    "es": {
        "anteayer": ("day", -2), "ayer": ("day", -1), "hoy": ("day", 0), "mañana": ("day", 1), "pasado mañana": ("day", 2),
        "la semana pasada": ("week", -1), "esta semana": ("week", 0), "la próxima semana": ("week", 1), "el mes pasado": ("month", -1), "este mes": ("month", 0), "el próximo mes": ("month", 1),
        "el año pasado": ("year", -1), "este año": ("year", 0), "el próximo año": ("year", 1),
    },
}
# Amounts from now (#: a number, *: a unit) with their direction, the words for units, and for one to ten.
AMOUNTS = {
    "en": {"# * ago": -1, "in # *": 1}, "de": {"vor # *": -1, "in # *": 1}, "fr": {"il y a # *": -1, "dans # *": 1}, "es": {"hace # *": -1, "dentro de # *": 1, "en # *": 1},
}
UNIT_WORDS = {
    "en": {"second": "second seconds", "minute": "minute minutes", "hour": "hour hours", "day": "day days", "week": "week weeks", "month": "month months", "year": "year years"},
    "de": {"second": "sekunde sekunden", "minute": "minute minuten", "hour": "stunde stunden", "day": "tag tage tagen", "week": "woche wochen", "month": "monat monate monaten", "year": "jahr jahre jahren"},
    "fr": {"second": "seconde secondes", "minute": "minute minutes", "hour": "heure heures", "day": "jour jours", "week": "semaine semaines", "month": "mois", "year": "an ans année années"},
    "es": {"second": "segundo segundos", "minute": "minuto minutos", "hour": "hora horas", "day": "día días", "week": "semana semanas", "month": "mes meses", "year": "año años"},
}
NUMBER_WORDS = {
    "en": "one two three four five six seven eight nine ten", "de": "eins zwei drei vier fünf sechs sieben acht neun zehn", "fr": "un deux trois quatre cinq six sept huit neuf dix", "es": "uno dos tres cuatro cinco seis siete ocho nueve diez",
}
ONES = {"en": "a an", "de": "ein eine einem einer einen", "fr": "une", "es": "un una"}
MONTH_WORDS = {
    "en": "january february march april may june july august september october november december", "de": "januar februar märz april mai juni juli august september oktober november dezember",
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre", "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
}
LANGUAGES = tuple(PHRASES)
_TOKEN = re.compile(r"\d+(?:[.,]\d+)?(?!\w)|\w+")
_GAP = re.compile(r"\s+|\s?[-'’]\s?")
_ABSOLUTE = re.compile(r"\b(\d{4})[-/.](\d{1,2})(?:[-/.](\d{1,2}))?(?:[ T](\d{1,2}):(\d{2}))?\b")
MONTHS = {w: n % 12 + 1 for own in MONTH_WORDS.values() for n, w in enumerate(own.split())} | {w[:3]: n + 1 for n, w in enumerate(MONTH_WORDS["en"].split())}
_MONTH = "(" + "|".join(sorted(MONTHS, key=len, reverse=True)) + ")"
_NAMED = re.compile(rf"\b(?:(\d{{1,2}})(?:st|nd|rd|th|er|\.)?\s+(?:de\s+)?{_MONTH}|{_MONTH}\s+(\d{{1,2}})(?:st|nd|rd|th)?)\b(?:,?\s+(?:de[l]?\s+)?(\d{{4}})\b)?", re.I)
#: Seconds of a mean month and year, for amounts that are no whole numbers.
_MEAN = {"month": 2_629_746, "year": 31_556_952}


def shifted(moment: datetime, months: int) -> datetime:
    """Months added, the day cut to the end of the month."""
    n = moment.year * 12 + moment.month - 1 + months
    first = moment.replace(year=n // 12, month=n % 12 + 1, day=1)
    last = ((first + timedelta(days=32)).replace(day=1) - timedelta(days=1)).day
    return first.replace(day=min(moment.day, last))


def calendar_range(moment: datetime, grain: str) -> tuple[datetime, datetime]:
    """The calendar unit that holds a moment; weeks start on Monday."""
    start = moment.replace(microsecond=0)
    start = start.replace(second=0) if grain != "second" else start
    start = start.replace(minute=0) if grain not in ("second", "minute") else start
    start = start.replace(hour=0) if grain in ("day", "week", "month", "year") else start
    if grain == "week":
        start -= timedelta(days=start.weekday())
    if grain in ("month", "year"):
        start = start.replace(day=1, month=1 if grain == "year" else start.month)
        return start, shifted(start, 12 if grain == "year" else 1)
    return start, start + timedelta(seconds=_UNITS[grain])


def _moved(moment: datetime, grain: str, n: float) -> datetime:
    if grain in _MEAN and n == int(n):
        return shifted(moment, int(n) * (12 if grain == "year" else 1))
    return moment + timedelta(seconds=n * {**_UNITS, **_MEAN}[grain])


def _last_one(here: datetime, month: int, day: int) -> datetime:
    """A day of the year without its year: the last one that was."""
    found = here.replace(month=month, day=day, hour=0, minute=0, second=0, microsecond=0)
    return found if found <= here else found.replace(year=found.year - 1)


@lru_cache(maxsize=16)
def phrase_trie(languages: tuple[str, ...] = LANGUAGES) -> dict:
    """The phrases and amounts of the languages as one trie of words. A node maps words (``#``: a number) to nodes, and "" to what ends there: (grain, steps or direction, language).

    Of phrases that several languages write alike the first language in the given order counts.
    """
    root: dict = {}

    def put(words: list[str], value: tuple) -> None:
        node = root
        for w in words:
            node = node.setdefault(w, {})
        node.setdefault("", value)

    for language in languages:
        for phrase, (grain, steps) in PHRASES[language].items():
            put(_TOKEN.findall(phrase), (grain, steps, language))
        for pattern, sign in AMOUNTS[language].items():
            for grain, words in UNIT_WORDS[language].items():
                for word in words.split():
                    put(_TOKEN.findall(pattern.replace("*", word).replace("#", "0")), (grain, sign, language))
    return root


@lru_cache(maxsize=16)
def _number_words(languages: tuple[str, ...]) -> dict[str, int]:
    found: dict[str, int] = {}
    for language in languages:
        for n, word in enumerate(NUMBER_WORDS[language].split()):
            found.setdefault(word, n + 1)
        for word in ONES[language].split():
            found.setdefault(word, 1)
    return found


def phrases_in(text: str, languages: tuple[str, ...] = LANGUAGES) -> list[tuple[int, int, str, float, str]]:
    """(start, end, grain, steps from now, language) of the phrases of a text: one walk over its words, at each the longest phrase that begins there; words stand apart by white space, a hyphen or an apostrophe."""
    trie, numbers = phrase_trie(languages), _number_words(languages)
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    words = [(m.group(), *m.span()) for m in _TOKEN.finditer(low)]
    out, k = [], 0
    while k < len(words):
        best, i = None, k
        walks_ = [(trie, None)]  # a word may be itself and a number
        while walks_ and i < len(words):
            word, start, end = words[i]
            if i > k and not _GAP.fullmatch(low, words[i - 1][2], start):
                break
            number = float(word.replace(",", ".")) if word[0].isdigit() and word.replace(",", "").replace(".", "").isdecimal() else numbers.get(word)
            walks_ = [(node[word], n) for node, n in walks_ if word in node and word != "0"] + [(node["0"], number) for node, n in walks_ if number is not None and n is None and "0" in node]
            for node, n in walks_:
                if "" in node:
                    grain, steps, language = node[""]
                    best = (words[k][1], end, grain, steps if n is None else steps * n, language, i + 1)
            i += 1
        if best:
            out.append(best[:5])
            k = best[5]
        else:
            k += 1
    return out


def last_words(languages: tuple[str, ...] = LANGUAGES) -> str:
    """A pattern that every text with a phrase or a date fits: a digit, or a word that ends a phrase."""
    found: set[str] = set()

    def walk(node: dict) -> None:
        for word, child in node.items():
            if word:
                found.update([word] if "" in child else [])
                walk(child)

    walk(phrase_trie(languages))
    return r"(?iu)\d|(?<![\p{L}\p{N}_])(?:" + "|".join(map(re.escape, sorted(found))) + r")(?![\p{L}\p{N}_])"


def resolve(text: str, now: datetime, zone: str = "UTC", languages: tuple[str, ...] = LANGUAGES) -> list[tuple[float, float, str, float, str]]:
    """(start, end, grain, confidence, expression) in epoch seconds; one per range, the surest and then the longest expression. Phrases come before dates, and no two expressions overlap."""
    here = now.astimezone(ZoneInfo(zone))
    found = []
    taken: list[tuple[int, int]] = []

    def add(span: tuple[int, int], start: datetime, end: datetime, grain: str, confidence: float) -> None:
        if all(span[1] <= a or b <= span[0] for a, b in taken):
            taken.append(span)
            found.append((start.timestamp(), end.timestamp(), grain, confidence, text[span[0] : span[1]]))

    for start, end, grain, steps, _ in phrases_in(text, languages):
        try:
            add((start, end), *calendar_range(_moved(here, grain, steps), grain), grain, 1.0)
        except (ValueError, OverflowError):
            continue  # no such year
    for m in _ABSOLUTE.finditer(text):
        try:
            day = datetime(int(m[1]), int(m[2]), int(m[3] or 1), int(m[4] or 0), int(m[5] or 0), tzinfo=ZoneInfo(zone))
        except ValueError:
            continue
        grain = ("minute" if m[4] else "day") if m[3] else "month"
        add(m.span(), *calendar_range(day, grain), grain, 0.9)
    for m in _NAMED.finditer(text):
        month = MONTHS[(m[2] or m[3]).lower()]
        try:  # a date that names its year stands for that year
            day = datetime(int(m[5]), month, int(m[1] or m[4]), tzinfo=ZoneInfo(zone)) if m[5] else _last_one(here, month, int(m[1] or m[4]))
        except ValueError:
            continue
        grain = "year" if m[5] else "day"
        add(m.span(), *calendar_range(day, grain), grain, 0.9)
    best: dict = {}
    for row in found:
        key, rank = row[:3], (row[3], len(row[4]))
        if key not in best or rank > best[key][0]:
            best[key] = (rank, row)
    return sorted(r for _, r in best.values())


ENGINES: dict[str, Callable] = {"phrases": resolve}
#: what a text needs at least to be given to an engine
NEEDED: dict[str, Callable[[], str]] = {"phrases": last_words}


def register_engine(name: str, engine: Callable) -> None:
    ENGINES[name] = engine


def resolved(queries: DataFrame, now: float, zone: str = "UTC", engine: str = "phrases") -> DataFrame:
    """Queries (query_id, text, weight) as ranges (query_id, start, end, grain, confidence, query_weight, expression)."""
    run_one = ENGINES[engine]
    queries = queries.where(F.rlike("text", F.lit(NEEDED[engine]()))) if engine in NEEDED else queries  # most texts have no expression

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        moment = datetime.fromtimestamp(now, timezone.utc)
        for batch in batches:
            rows = [(q, s, e, g, c, w, x) for q, t, w in zip(batch["query_id"], batch["text"], batch["weight"], strict=True) for s, e, g, c, x in run_one(t or "", moment, zone)]
            yield pd.DataFrame(rows, columns=["query_id", "start", "end", "grain", "confidence", "query_weight", "expression"])

    return queries.select(F.col("query_id").cast("string").alias("query_id"), "text", "weight").mapInPandas(run, "query_id string, start double, end double, grain string, confidence double, query_weight double, expression string")


def strongest(ranges: DataFrame) -> DataFrame:
    """The surest range of each query, weighted; of equal ones the earliest."""
    rank = F.struct(F.col("confidence") * F.col("query_weight"), -F.col("start"), -F.col("end"))
    return ranges.groupBy("query_id").agg(F.max_by(F.struct(*[c for c in ranges.columns if c != "query_id"]), rank).alias("x")).select("query_id", "x.*")
