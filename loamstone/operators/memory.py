"""The write path of a memory: row texts, extraction appliers, versioned statements, open threads, emotions, diffs and rendering."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import text as T
from . import conversation as V
from . import tables as B

NO_IDS = "array<bigint>"

# ---- texts of rows


def fact_text(kind: Column, content: Column) -> Column:
    return F.concat(F.lit("["), kind, F.lit("] "), content)


def directive_text(content: Column, keywords: Column) -> Column:
    return F.when(F.size(keywords) > 0, F.concat(content, F.lit(" (keywords: "), F.array_join(keywords, ", "), F.lit(")"))).otherwise(content)


def summary_text(name: Column, others: Column, summary: Column) -> Column:
    part = lambda label, value: F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"{label}: "), value))
    return F.concat_ws(" . ", part("name", name), part("aliases", F.array_join(others, ", ")), part("summary", summary))


def thread_text(content: Column, follow_up: Column) -> Column:
    return F.trim(F.concat_ws(" ", content, follow_up))


def stamped(text: Column, moment: Column, now: float, style: str = "both") -> Column:
    """A text after its time: absolute, relative or both."""
    absolute = F.date_format(F.timestamp_seconds(moment), "yyyy-MM-dd HH:mm")
    relative = T.age_label(F.greatest(F.lit(0.0), F.lit(now) - moment))
    label = {"absolute": absolute, "relative": relative, "both": F.concat(absolute, F.lit(", "), relative)}[style]
    return F.when(moment.isNull(), text).otherwise(F.concat(F.lit("["), label, F.lit("] "), text))


def heartbeat_text(kind: Column, summary: Column) -> Column:
    return F.concat(F.lit("["), kind, F.lit("] "), summary)


def row_items(rows: DataFrame, text: Column, memory: str, score: str = "score") -> DataFrame:
    """(memory, id, text, score, metadata): remembered rows as items of a prompt; metadata has what else is known of a row, as text."""
    rest = [c for c in rows.columns if c not in ("id", score)]
    metadata = F.map_filter(F.create_map(*[x for c in rest for x in (F.lit(c), F.col(c).cast("string"))]), lambda _, v: v.isNotNull()) if rest else F.create_map().cast("map<string,string>")
    return rows.select(F.lit(memory).alias("memory"), "id", text.alias("text"), F.col(score).alias("score"), metadata.alias("metadata"))


# ---- applying what was extracted


def applied_facts(extracted: DataFrame, known: DataFrame, window_ids: DataFrame | None = None, scope: str = "user_id") -> DataFrame:
    """Extracted rows (id, scope, content, importance, confidence, source_message_ids) that may be stored.

    Ids outside the window are dropped from the provenance; rows without text or provenance go, and texts known in their scope, case aside.
    """
    rows = extracted
    if window_ids is not None:
        good = rows.select("id", F.explode("source_message_ids").alias("m")).join(window_ids.select(F.col("id").alias("m")), "m", "left_semi")
        cited = good.groupBy("id").agg(F.array_sort(F.collect_set("m")).alias("source_message_ids"))
        rows = rows.drop("source_message_ids").join(cited, "id")
    rows = rows.where(F.size("source_message_ids") > 0).withColumns({c: T.clip(F.col(c)) for c in ("importance", "confidence") if c in rows.columns})
    return B.new_texts(rows, known, scope).select(extracted.columns)


def evidenced(updates: DataFrame, messages: DataFrame, roles: list[str]) -> DataFrame:
    """Updates that cite a message of an allowed role in the window (messages: id, role), with those ids only."""
    allowed = messages.where(F.col("role").isin(*roles)).select(F.col("id").alias("m"))
    cited = updates.select("update_id", F.explode("source_message_ids").alias("m")).join(allowed, "m", "left_semi")
    good = cited.groupBy("update_id").agg(F.array_sort(F.collect_set("m")).alias("source_message_ids"))
    return updates.drop("source_message_ids").join(good, "update_id").select(updates.columns)


def applied_directives(extracted: DataFrame, known: DataFrame, window_ids: DataFrame | None = None, scope: str = "user_id") -> DataFrame:
    """``applied_facts`` for directives: their keywords are trimmed and without blanks or repeats."""
    words = F.array_distinct(F.filter(F.transform(F.coalesce("retrieval_keywords", F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != ""))
    return applied_facts(extracted.withColumn("retrieval_keywords", words), known, window_ids, scope)


def applied_episodes(extracted: DataFrame, messages: DataFrame, axes: list[str], window_ids: DataFrame | None = None) -> DataFrame:
    """Extracted episodes (id, summary, importance, emotional_shift, occurred_at, source_message_ids, ..) that may be stored: with text and provenance, known axes only
    and a time from what they cite; equal texts are kept."""
    rows = extracted.where(F.trim("summary") != "")
    if window_ids is not None:
        good = rows.select("id", F.explode("source_message_ids").alias("m")).join(window_ids.select(F.col("id").alias("m")), "m", "left_semi")
        rows = rows.drop("source_message_ids").join(good.groupBy("id").agg(F.array_sort(F.collect_set("m")).alias("source_message_ids")), "id")
    rows = rows.where(F.size("source_message_ids") > 0).withColumns({"importance": T.clip(F.col("importance")), "emotional_shift": T.emotion(F.col("emotional_shift"), axes)})
    return V.backfilled(rows.select(extracted.columns), messages)


def applied_emotions(states: DataFrame, changes: DataFrame, axes: list[str]) -> DataFrame:
    """States (user_id, mood, dims, comment) after changes (user_id, mood, deltas, comment): a mood with a known axis replaces the old one whole, deltas add to the dims, a comment with text replaces."""
    c = changes.select("user_id", F.col("mood").alias("_m"), F.col("deltas").alias("_d"), F.col("comment").alias("_c"))
    both = states.join(c, "user_id", "left")
    known = T.emotion(F.col("_m"), axes)
    return both.select(
        "user_id",
        F.when(F.coalesce(F.size(known), F.lit(0)) > 0, mood_set(known, axes)).otherwise(F.col("mood")).alias("mood"),
        F.when(F.col("_d").isNotNull(), T.shifted_dims(F.col("dims"), F.col("_d"))).otherwise(F.col("dims")).alias("dims"),
        F.when(F.trim(F.coalesce("_c", F.lit(""))) != "", F.col("_c")).otherwise(F.col("comment")).alias("comment"),
    )


def versioned(rows: DataFrame, changes: DataFrame, now: float) -> DataFrame:
    """Statements (id, content, history array<struct<content, updated_at>>, updated_at, source_message_ids) after changes (id, content, source_message_ids): what
    was there goes to the history and sources join; a change that changes nothing leaves the row alone."""
    c = changes.select("id", F.col("content").alias("_c"), F.col("source_message_ids").alias("_s"))
    both = rows.join(c, "id", "left")
    hit = F.col("_c").isNotNull() & (F.col("_c") != F.col("content"))
    return both.withColumns({
        "history": F.when(hit, F.concat("history", F.array(F.struct("content", "updated_at")))).otherwise(F.col("history")),
        "source_message_ids": F.when(hit, F.array_union("source_message_ids", F.coalesce("_s", F.array().cast(NO_IDS)))).otherwise(F.col("source_message_ids")),
        "updated_at": F.when(hit, F.lit(now)).otherwise(F.col("updated_at")),
        "content": F.when(hit, F.col("_c")).otherwise(F.col("content")),
    }).select(rows.columns)


def thread_states(updates: DataFrame) -> DataFrame:
    """(thread, status, content, follow_up, not_before, resolution, resolved_at) after updates (thread, seq, action, content, follow_up, not_before, resolution, at) in order of seq.

    create opens a thread that is not there yet and needs content; update changes an open one; resolve and dismiss close an open one and need a resolution that is not blank; reopen
    opens and forgets the resolution. What an action supplies besides (content that is not blank, follow_up, not_before) is carried by it if it applies, and not otherwise.

    Whether a thread is open before a row is told by the last row before it that opens or closes: rows are dealt over ranges of (thread, seq), so no thread is one task's.
    """
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    first = updates.where((F.col("action") == "create") & (text("content") != "")).groupBy("thread").agg(F.min("seq").alias("_open"))
    own = updates.join(first, "thread").where(F.col("seq") >= F.col("_open"))
    closes = F.col("action").isin("resolve", "dismiss") & (text("resolution") != "")
    opens = (F.col("action") == "reopen") | (F.col("seq") == F.col("_open"))
    own = own.withColumn("_turn", F.when(opens | closes, F.struct("thread", "seq", opens.alias("open"))))
    ranged = B.carried(B.ranges_in_order(own, ["thread", "seq"]), F.col("_turn"), "_carried", F.max)
    inside = F.max("_turn").over(Window.partitionBy("_range").orderBy("thread", "seq").rowsBetween(Window.unboundedPreceding, -1))
    before = ranged.withColumn("_before", F.coalesce(inside, F.col("_carried")))
    was_open = F.coalesce((F.col("_before.thread") == F.col("thread")) & F.col("_before.open"), F.lit(False))
    applied = before.where(opens | (was_open & (closes | (F.col("action") == "update"))))
    last = lambda c, when: F.max_by(c, F.when(when, F.col("seq")))
    done = applied.groupBy("thread").agg(
        F.max_by(F.struct(F.col("action"), text("resolution").alias("text"), F.col("at")), F.when(opens | closes, F.col("seq"))).alias("x"),
        last(text("content"), text("content") != "").alias("content"), last(text("follow_up"), F.col("follow_up").isNotNull()).alias("follow_up"), last(F.col("not_before"), F.col("not_before").isNotNull()).alias("not_before"),
    )
    status = F.when(F.col("x.action") == "resolve", "resolved").when(F.col("x.action") == "dismiss", "dismissed").otherwise("open")
    closed = status != "open"
    return done.select("thread", status.alias("status"), "content", F.coalesce("follow_up", F.lit("")).alias("follow_up"), "not_before", F.when(closed, F.col("x.text")).alias("resolution"), F.when(closed, F.col("x.at")).alias("resolved_at"))


def merged_statements(rows: DataFrame, scope: str | None = None) -> DataFrame:
    """Statements (id, content, visibility, disclosed_to) that say the same, case aside, over all rows or inside a scope: the first one each, with the union of its audience.

    One private repetition makes it private; nothing private becomes public by this. An audience is a set of persons, so a statement that very many rows repeat stays small.
    """
    keys = [T.folded(F.col("content")).alias("_k"), *([scope] if scope else [])]
    each = rows.withColumn("_who", F.explode_outer("disclosed_to"))
    return each.groupBy(*keys).agg(
        F.min("id").alias("id"), F.min_by("content", "id").alias("content"), F.when(F.max(F.col("visibility") == "private"), "private").otherwise(F.min_by("visibility", "id")).alias("visibility"),
        F.array_sort(F.collect_set("_who")).alias("disclosed_to"),
    ).drop("_k")


def updated_statements(rows: DataFrame, updates: DataFrame) -> DataFrame:
    """Statements (id, content, visibility, disclosed_to) after updates (id, seq, operation, content, visibility, people), in order of seq.

    disclose adds people to the audience; revise, which needs content, replaces content and audience: who heard the old version need not know the new one. An update that is private
    makes a statement private, no update makes it public. Updates of unknown statements, and other operations, change nothing.
    """
    text = F.trim(F.coalesce("content", F.lit("")))
    valid = updates.where((F.col("operation") == "disclose") | ((F.col("operation") == "revise") & (text != "")))
    whole = valid.groupBy("id").agg(
        F.max_by(F.struct(text.alias("content"), F.col("seq")), F.when(F.col("operation") == "revise", F.col("seq"))).alias("_last"), F.max(F.coalesce(F.col("visibility") == "private", F.lit(False))).alias("_private"),
    )
    heard = valid.join(whole.select("id", "_last"), "id").where(F.col("_last").isNull() | (F.col("seq") >= F.col("_last.seq")))
    heard = heard.select("id", F.explode("people").alias("_who")).groupBy("id").agg(F.collect_set("_who").alias("_heard"))
    none = F.array().cast("array<string>")
    out = rows.join(whole, "id", "left").join(heard, "id", "left")
    known = F.when(F.col("_last").isNull(), F.coalesce("disclosed_to", none)).otherwise(none)
    return out.withColumns({
        "disclosed_to": F.when(F.col("_private").isNull(), F.col("disclosed_to")).otherwise(F.array_sort(F.array_union(known, F.coalesce("_heard", none)))),
        "content": F.coalesce("_last.content", "content"),
        "visibility": F.when(F.col("_private"), "private").otherwise(F.col("visibility")),
    }).select(rows.columns)


def profile_updates(profiles: DataFrame, updates: DataFrame) -> DataFrame:
    """Profiles (user_id, summary, aliases) with the new summaries and the sorted union of aliases; new users come."""
    u = updates.select("user_id", F.col("summary").alias("_s"), F.col("aliases").alias("_a"))
    none = F.array().cast("array<string>")
    return profiles.join(u, "user_id", "full_outer").select("user_id", F.coalesce("_s", "summary").alias("summary"), F.array_sort(F.array_union(F.coalesce("aliases", none), F.coalesce("_a", none))).alias("aliases"))


def normalised_events(rows: DataFrame) -> DataFrame:
    """Calendar rows with ``valid``: a title, and either start before end, or weekdays within 0 to 6 with a local start and minutes in a day's bounds; lists without repeats."""
    once = (F.col("kind") == "event") & (F.col("start_at") < F.col("end_at"))
    weekly = (F.col("kind") == "routine") & (F.size("weekdays") > 0) & F.forall("weekdays", lambda d: d.between(0, 6)) & F.col("start_local").rlike("^([01]\\d|2[0-3]):[0-5]\\d$") & F.col("duration_minutes").between(1, 1440)
    lists = {c: F.array_sort(F.array_distinct(c)) for c in ("weekdays", "attendees")}
    return rows.withColumn("valid", (F.trim("title") != "") & F.coalesce(once, F.lit(False)) | (F.trim("title") != "") & F.coalesce(weekly, F.lit(False))).withColumns(lists)


# ---- emotions


def mood_set(values: Column, axes: list[str]) -> Column:
    """Every axis, 0 where it is missing, within [0, 1]."""
    return F.map_from_arrays(F.array(*map(F.lit, axes)), F.array(*[F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(values[a], F.lit(0.0)))) for a in axes]))


def emotion_lines(rows: DataFrame, dims: str = "dims", who: str = "user_id") -> DataFrame:
    """(who, axis, line) with two decimals."""
    return rows.select(who, F.explode(dims).alias("axis", "v")).select(who, "axis", F.format_string("%s: %.2f", F.col("axis"), F.col("v")).alias("line"))


def emotion_changes(before: DataFrame, after: DataFrame, least: float = 1e-9) -> DataFrame:
    """(user_id, axis, before, after, delta) of the axes that moved."""
    side = lambda df, name: df.select("user_id", F.explode("dims").alias("axis", name))
    both = side(before, "before").join(side(after, "after"), ["user_id", "axis"], "full_outer").fillna({"before": 0.0, "after": 0.0})
    return both.withColumn("delta", F.col("after") - F.col("before")).where(F.abs("delta") > least)


def relation_changes(before: DataFrame, after: DataFrame, least: float = 1e-9) -> DataFrame:
    """(user_id, axes, comment_before, comment_after, comment_changed) of the users whose dimensions moved or whose comment is another one; axes: the number of those that moved. Rows: (user_id, dims, comment)."""
    moved = emotion_changes(before, after, least).groupBy("user_id").agg(F.count("*").alias("axes"))
    side = lambda df, name: df.select("user_id", F.coalesce("comment", F.lit("")).alias(name))
    said = side(before, "comment_before").join(side(after, "comment_after"), "user_id", "full_outer").fillna("", ["comment_before", "comment_after"])
    out = said.join(moved, "user_id", "left").fillna({"axes": 0}).withColumn("comment_changed", F.col("comment_before") != F.col("comment_after"))
    return out.where("axes > 0 or comment_changed").select("user_id", "axes", "comment_before", "comment_after", "comment_changed")


def emotion_items(baseline: Column, mood: Column, dims: DataFrame) -> DataFrame:
    """(section, who, axis, line) of emotion rows (user_id, dims) of users, with the character's baseline and mood (maps) once: what an emotion memory recalls."""
    one = dims.sparkSession.range(1)
    own = one.select(F.lit("baseline").alias("section"), F.lit(None).cast("string").alias("who"), baseline.alias("v")).unionByName(one.select(F.lit("mood").alias("section"), F.lit(None).cast("string").alias("who"), mood.alias("v")))
    every = own.unionByName(dims.select(F.lit("user").alias("section"), F.col("user_id").cast("string").alias("who"), F.col("dims").alias("v")))
    return every.select("section", "who", F.explode("v").alias("axis", "x")).select("section", "who", "axis", F.format_string("%s: %.2f", F.col("axis"), F.col("x")).alias("line"))


def thread_effective(importance: Column, status: Column, familiar: Column) -> Column:
    """A thread does not age while it is open."""
    return F.when(status == "open", S.intrinsic_score(importance)).otherwise(familiar)


def calendar_effective(importance: Column) -> Column:
    """Calendar rows never age."""
    return F.coalesce(importance, F.lit(0.0))


def episodic_effective(familiar: Column, shift: Column, mood: Column) -> Column:
    return familiar * (1 + T.emotion_similarity(shift, mood))


# ---- diffs and rendering


def profile_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(user_id, old, new, aliases_added) of profiles that changed."""
    none = F.array().cast("array<string>")
    side = lambda df, s, a: df.select("user_id", F.col("summary").alias(s), F.col("aliases").alias(a))
    both = side(before, "old", "_a").join(side(after, "new", "_b"), "user_id", "full_outer")
    both = both.withColumn("aliases_added", F.array_except(F.coalesce("_b", none), F.coalesce("_a", none)))
    return both.where(~F.col("old").eqNullSafe(F.col("new")) | (F.size("aliases_added") > 0)).drop("_a", "_b")


def preview(messages: DataFrame, chat: str = "chat_id", most: int = 160) -> DataFrame:
    """(chat, preview): the newest user turn with text, white space collapsed, cut with an ellipsis."""
    text = F.trim(F.regexp_replace("content", "\\s+", " "))
    last = messages.where((F.col("role") == "user") & (text != "")).groupBy(chat).agg(F.max_by(text, "id").alias("t"))
    return last.select(chat, F.when(F.length("t") > most, F.concat(F.substring("t", 1, most - 1), F.lit("…"))).otherwise(F.col("t")).alias("preview"))


def grouped_render(items: DataFrame, participants: list[str], per: str = "section") -> DataFrame:
    """(per, text): items (participant, position, text) under each participant's name, in the given order, then others, then those of none."""
    given = F.array_position(F.array(*map(F.lit, participants)), F.col("participant"))
    place = F.when(F.col("participant").isNull(), 2).when(given > 0, 0).otherwise(1)
    blocks = items.groupBy(per, "participant").agg(F.first(place).alias("a"), F.first(F.coalesce(given, F.lit(0))).alias("b"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "text"))), lambda x: x["text"]), "\n").alias("body"))
    head = F.when(F.col("participant").isNull(), F.col("body")).otherwise(F.concat(F.col("participant"), F.lit(":\n"), F.col("body")))
    whole = blocks.groupBy(per).agg(F.sort_array(F.collect_list(F.struct("a", "b", F.coalesce("participant", F.lit("")).alias("p"), head.alias("text")))).alias("x"))
    return whole.select(per, F.array_join(F.transform("x", lambda x: x["text"]), "\n\n").alias("text"))


def overview(memories: DataFrame, memory: str = "memory", user: str = "user_id") -> DataFrame:
    """(memory, rows, users), a row per memory, in one pass."""
    return memories.groupBy(F.col(memory).alias("memory")).agg(F.count("*").alias("rows"), F.count_distinct(user).alias("users"))


def known_facts(rows: DataFrame, most: int = 8, per: str = "user_id") -> DataFrame:
    order = Window.partitionBy(per).orderBy(F.desc("importance"), "id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def sections_rendered(items: DataFrame, sections: list[str], titles: dict[str, str] | None = None) -> DataFrame:
    """(query_id, prompt): items (query_id, section, position, text) of a prompt under the titles of their sections, in the given order; blank texts and empty sections are left out.

    A prompt is as long as its budget of tokens, so a row holds one.
    """
    place = F.array_position(F.array(*map(F.lit, sections)), F.col("section"))
    own = items.where((place > 0) & (F.trim(F.coalesce("text", F.lit(""))) != "")).withColumn("_at", place)
    title = F.create_map(*[F.lit(x) for s in sections for x in (s, (titles or {}).get(s, s))])
    lines = F.transform(F.array_sort(F.collect_list(F.struct("position", F.trim("text").alias("text")))), lambda x: F.concat(F.lit("- "), x["text"]))
    body = own.groupBy("query_id", "_at", "section").agg(F.array_join(lines, "\n").alias("body"))
    blocks = body.select("query_id", F.struct("_at", F.concat(F.lit("## "), title[F.col("section")], F.lit("\n"), F.col("body")).alias("text")).alias("b"))
    return blocks.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda x: x["text"]), "\n\n").alias("prompt"))


def suppressed(items: DataFrame, surfaced: DataFrame) -> DataFrame:
    """Graph items whose source (source) has already surfaced directly (query_id, source) go; items without a source stay."""
    return items.join(surfaced.select("query_id", "source").distinct(), ["query_id", "source"], "left_anti")


def fan_out(candidates: DataFrame, participants: DataFrame, limit: int) -> DataFrame:
    """The best ``limit`` items of each participant (participant, id, score), then each node once at its best."""
    order = Window.partitionBy("participant").orderBy(F.desc("score"), "id")
    best = candidates.join(participants, "participant", "left_semi").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit)
    return best.groupBy("id").agg(F.max("score").alias("score"), F.max_by("participant", F.struct("score", "participant")).alias("participant"))


def fan_out_all(items: DataFrame) -> DataFrame:
    """(id, score, participants): items (participant, id, score) of a group chat, each node once at its best, with everyone who recalled it."""
    return items.groupBy("id").agg(F.max("score").alias("score"), F.array_sort(F.collect_set("participant")).alias("participants"))


# ---- graph projections


def fact_graph(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts (id, user_id, content, importance, confidence) as nodes and as edges from their subjects."""
    node, person = F.concat(F.lit("fact:"), "id"), F.concat(F.lit("person:"), "user_id")
    nodes = facts.select(node.alias("id"), F.lit("fact").alias("kind"), F.col("content").alias("text"), F.array("user_id").alias("owners"), "importance", "confidence")
    weight = F.greatest(F.lit(0.3), F.least(F.lit(1.0), 0.3 + 0.7 * F.col("importance")))
    edges = facts.select(S.edge_id(F.lit("fact"), person, node).alias("id"), F.lit("fact").alias("kind"), person.alias("src"), node.alias("dst"), weight.alias("weight"), "confidence", "importance")
    return nodes, edges


def ingested_facts(facts: DataFrame, subjects: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, members) of facts (id, user_id, content, importance, confidence, chat_id) with what a model found in them: subjects (id, subject node; missing: the person of the
    user, or the self) and entities (id, name, entity node, kind_label). Blank contents are left out.

    Each fact has an edge from its subject, by its importance, and one of 0.4 from every entity; all of them belong to the fact's user, and to the character if the fact is about the self.
    members (id, participants) are the facts with what they share: ``graph.shared_cliques`` and ``graph.shared_pairs`` wire them together.
    """
    own = facts.where(F.trim(F.coalesce("content", F.lit(""))) != "").join(subjects.select("id", "subject"), "id", "left")
    person = F.when(F.coalesce("user_id", F.lit("")) != "", F.concat(F.lit("person:"), "user_id")).otherwise("self")
    own = own.select(F.concat(F.lit("fact:"), F.col("id").cast("string")).alias("fact"), F.col("id").alias("_key"), F.coalesce("subject", person).alias("subject"), F.nullif(F.col("user_id"), F.lit("")).alias("owner"), F.trim("content").alias("text"), T.clip(F.col("importance")).alias("importance"), T.clip(F.col("confidence")).alias("confidence"), "chat_id")
    named = entities.select(F.col("id").alias("_key"), "entity", F.col("name").alias("_name"), "kind_label").join(own.select("_key", "fact", "owner", "subject", "importance", "confidence"), "_key").dropDuplicates(["fact", "entity"])
    about = F.col("subject") == "self"
    each = own.select(F.col("fact").alias("id"), F.lit("fact").alias("kind"), "text", F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("kind_label"), "owner", about.alias("scoped"), "importance", "confidence", "chat_id")
    ends = own.select(F.col("subject").alias("id"), F.when(F.col("subject") == "self", "self").otherwise("person").alias("kind"), "owner", about.alias("scoped"))
    things = named.select(F.col("entity").alias("id"), F.lit("entity").alias("kind"), F.col("_name").alias("name"), "kind_label", "owner", about.alias("scoped"))
    every = each.unionByName(ends, allowMissingColumns=True).unionByName(things, allowMissingColumns=True)
    nodes = every.groupBy("id", "kind").agg(*[F.min(c).alias(c) for c in ("text", "name", "kind_label", "importance", "confidence", "chat_id")], F.array_sort(F.collect_set("owner")).alias("owners"), F.max("scoped").alias("character_scoped"))
    edge = lambda df, src, weight: df.select(S.edge_id(F.lit("fact"), F.col(src), F.col("fact")).alias("id"), F.lit("fact").alias("kind"), F.col(src).alias("src"), F.col("fact").alias("dst"), weight.alias("weight"), "confidence", "importance")
    edges = edge(own, "subject", F.greatest(F.lit(0.3), F.least(F.lit(1.0), 0.3 + 0.7 * F.col("importance")))).unionByName(edge(named.where("entity <> subject"), "entity", F.lit(0.4)))
    members = own.select(F.col("fact").alias("id"), F.col("subject").alias("p")).unionByName(named.select(F.col("fact").alias("id"), F.col("entity").alias("p"))).groupBy("id").agg(F.array_sort(F.collect_set("p")).alias("participants"))
    return nodes, edges, members


def episode_graph(episodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Episodes (id, user_id, summary, importance, emotional_shift, occurred_at, created_at) as nodes and as edges from their owners; a missing or zero time is the creation."""
    node, person = F.concat(F.lit("episode:"), "id"), F.concat(F.lit("person:"), "user_id")
    moment = F.when(F.coalesce("occurred_at", F.lit(0.0)) == 0, F.col("created_at")).otherwise(F.col("occurred_at"))
    nodes = episodes.select(node.alias("id"), F.lit("episode").alias("kind"), F.col("summary").alias("text"), F.array("user_id").alias("owners"), "importance", moment.alias("timestamp"))
    weight = F.greatest(F.lit(0.3), F.least(F.lit(1.0), 0.3 + 0.7 * T.emotional_impact(F.col("emotional_shift")) + 0.3 * F.col("importance")))
    edges = episodes.select(S.edge_id(F.lit("episode"), person, node).alias("id"), F.lit("episode").alias("kind"), person.alias("src"), node.alias("dst"), weight.alias("weight"))
    return nodes, edges


def projected_heartbeats(rows: DataFrame, least: float = 0.6, most: int = 200, per: str = "character") -> DataFrame:
    """The ``most`` weightiest rows (importance, created_at, id) of each character that weigh at least ``least``."""
    order = Window.partitionBy(per).orderBy(F.desc("importance"), F.desc("created_at"), F.desc("id"))
    return rows.where(F.col("importance") >= least).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


def resolved_subjects(facts: DataFrame, people: DataFrame, self_names: list[str]) -> DataFrame:
    """facts (id, subject) with the person they are about: ``self``, else a user id, else a name or alias (case aside; of several the least id), else a new person's id."""
    key = T.folded(F.col("subject"))
    by_user = people.select(F.col("user_id").alias("_u"), F.col("id").alias("_by_user")).where("_u is not null").dropDuplicates(["_u"])
    labels = people.select("id", F.explode(F.array_distinct(F.transform(F.concat(F.array("name"), "aliases"), lambda x: T.folded(x)))).alias("_l"))
    by_label = labels.groupBy("_l").agg(F.min("id").alias("_by_label"))
    out = facts.join(by_user, F.col("subject") == F.col("_u"), "left").join(by_label, key == F.col("_l"), "left")
    person = F.when(key.isin(*[n.strip().lower() for n in self_names]), "self").otherwise(F.coalesce("_by_user", "_by_label", F.concat(F.lit("person:"), T.slugify(F.col("subject")))))
    return out.select(*facts.columns, person.alias("person"))


def effective_timezone(actors: DataFrame, locations: DataFrame, world: str = "UTC") -> DataFrame:
    """(actor, timezone): that of the actor's place, else the actor's own, else the world's."""
    at = locations.select(F.col("location").alias("_l"), F.col("timezone").alias("_tz"))
    own = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    return actors.join(at, F.col("location") == F.col("_l"), "left").select("actor", F.coalesce(own("_tz"), own("timezone"), F.lit(world)).alias("timezone"))


def world_snapshot(states: DataFrame, facts: DataFrame, observer: str, now: float, most: int = 10) -> DataFrame:
    """What an observer sees: (kind, id, text) of actors at the same place or in public, and of visible facts, passing ones first, then local ones, then the newest."""
    here = states.where(F.col("actor") == observer).select(F.col("location").alias("_here"))
    near = states.where(F.col("actor") != observer).crossJoin(F.broadcast(here)).where((F.col("location") == F.col("_here")) | F.col("is_public"))  # one observer, one row
    known = facts.crossJoin(F.broadcast(here)).where(F.col("valid_until").isNull() | (F.col("valid_until") > now))
    seen = F.col("visibility").isin("public", "known") | F.array_contains("witnesses", observer) | ((F.col("visibility") == "local") & (F.col("location") == F.col("_here")))
    order = [F.col("valid_until").isNull(), F.coalesce(F.col("location") != F.col("_here"), F.lit(True)), F.desc("occurred_at"), F.desc("id")]
    top = known.where(F.coalesce(seen, F.lit(False))).orderBy(*order).limit(most)
    return near.select(F.lit("actor").alias("kind"), F.col("actor").alias("id"), F.col("activity").alias("text")).unionByName(top.select(F.lit("fact").alias("kind"), F.col("id").cast("string").alias("id"), F.col("content").alias("text")))


def next_action(actions: DataFrame, routines: DataFrame, now: float, days: int = 8) -> DataFrame:
    """(actor, at, what): the earliest pending action, else the earliest start of a routine after now within ``days``."""
    pending = actions.where("status = 'pending'").groupBy("actor").agg(F.min("due_at").alias("a"), F.min_by("name", F.struct("due_at", "name")).alias("an"))
    later = routines.where((F.col("start") > now) & (F.col("start") <= now + days * S.DAY)).groupBy("actor").agg(F.min("start").alias("r"), F.min_by("routine", F.struct("start", "routine")).alias("rn"))
    both = pending.join(later, "actor", "full_outer")
    return both.select("actor", F.coalesce("a", "r").alias("at"), F.coalesce("an", "rn").alias("what"))
