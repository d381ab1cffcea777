"""Conversations: rounds, neighbours, speakers, extraction offsets, provenance and dialogue windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def rounds(messages: DataFrame, chat: str = "chat_id") -> DataFrame:
    """(chat, round, first_id, last_id, content, occurred_at): a user message opens a round; what comes before the first is a round of its own."""
    run = Window.partitionBy(chat).orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    numbered = messages.withColumn("round", F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(run))
    lines = F.sort_array(F.collect_list(F.struct("id", "content")))
    moment = F.min_by("occurred_at", F.when(F.col("occurred_at").isNotNull(), F.col("id"))) if "occurred_at" in messages.columns else F.lit(None)
    return numbered.groupBy(chat, "round").agg(
        F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.count("*").alias("messages"),
        F.array_join(F.transform(lines, lambda x: x["content"]), "\n").alias("content"), moment.alias("occurred_at"),
    )


def neighbours(events: DataFrame, event_id: int, before: int = 2, after: int = 2, chat: str = "chat_id", order: str = "first_id", key: str = "event_id") -> DataFrame:
    """The events around one of the same chat, with their distance."""
    here = events.where(F.col(key) == event_id).select(chat)
    numbered = events.join(F.broadcast(here), chat, "left_semi").withColumn("_n", F.row_number().over(Window.partitionBy(chat).orderBy(order)))  # the one chat
    one = numbered.where(F.col(key) == event_id).select(chat, F.col("_n").alias("_at"))
    near = numbered.join(F.broadcast(one), chat).withColumn("distance", F.col("_n") - F.col("_at"))  # one row
    return near.where((F.col("distance") >= -before) & (F.col("distance") <= after) & (F.col("distance") != 0)).drop("_n", "_at")


def turns_since_extraction(messages: DataFrame, chat: str = "chat_id") -> DataFrame:
    """(chat, turns): user messages not extracted after the last one that is."""
    last = F.max(F.when(F.col("extracted"), F.col("id"))).over(Window.partitionBy(chat))
    marked = messages.withColumn("_last", F.coalesce(last, F.lit(-1)))
    return marked.groupBy(chat).agg(F.count_if((F.col("role") == "user") & ~F.col("extracted") & (F.col("id") > F.col("_last"))).alias("turns"))


def participants(messages: DataFrame, owner: str, chat: str = "chat_id") -> DataFrame:
    """(chat, user_id, position): users in the order of their first message, null is the owner, who comes first if missing."""
    seen = messages.where("role = 'user'").select(chat, F.coalesce("user_id", F.lit(owner)).alias("user_id"), "id").groupBy(chat, "user_id").agg(F.min("id").alias("first"))
    missing = messages.select(chat).distinct().join(seen.where(F.col("user_id") == owner), chat, "left_anti").select(chat, F.lit(owner).alias("user_id"), F.lit(-1).cast("long").alias("first"))
    return seen.unionByName(missing).select(chat, "user_id", F.row_number().over(Window.partitionBy(chat).orderBy("first")).alias("position"))


def last_user_message(messages: DataFrame, chat: str = "chat_id") -> DataFrame:
    return messages.where("role = 'user'").groupBy(chat).agg(F.max_by("content", "id").alias("content"), F.max("id").alias("id"))


def marked_extracted(messages: DataFrame, ids: DataFrame) -> DataFrame:
    hit = ids.select("id", F.lit(True).alias("_hit")).distinct()
    return messages.join(hit, "id", "left").withColumn("extracted", F.col("extracted") | F.coalesce("_hit", F.lit(False))).drop("_hit").select(messages.columns)


def provenance_links(events: DataFrame, facts: DataFrame, event_key: str = "event_id", fact_key: str = "fact_id", ids: str = "source_message_ids") -> DataFrame:
    """(event, fact) pairs that share a source message, each once."""
    side = lambda df, key: df.select(key, F.explode(F.array_distinct(ids)).alias("_m"))
    return side(events, event_key).join(side(facts, fact_key), "_m").select(event_key, fact_key).distinct()


def source_moment(rows: DataFrame, messages: DataFrame, key: str = "id", ids: str = "source_message_ids") -> DataFrame:
    """(key, moment): the time of the first listed message that has one, in the order of message ids."""
    each = rows.select(F.col(key).alias("_key"), F.explode(F.array_distinct(ids)).alias("_m"))
    moment = F.coalesce("occurred_at", "created_at")
    found = each.join(messages.select(F.col("id").alias("_m"), moment.alias("moment")), "_m").where("moment is not null")
    return found.groupBy(F.col("_key").alias(key)).agg(F.min_by("moment", "_m").alias("moment"))


def with_aliases(rows: DataFrame, alias_rows: DataFrame, key: str = "event_id", text: str = "content") -> DataFrame:
    """(result_id, text): each row's own text and one more per alias, so that a hit on either finds the row."""
    own = rows.select(F.col(key).alias("result_id"), F.col(text).alias("text"))
    return own.unionByName(alias_rows.join(rows.select(key), key, "left_semi").select(F.col(key).alias("result_id"), F.col("key_text").alias("text")))


def named_messages(messages: DataFrame, owners: DataFrame, chat: str = "chat_id") -> DataFrame:
    """(chat, id, role, content, name): messages as a model reads them; user rows of a chat with several participants carry a safe name of their speaker, all others null.

    messages: chat, id, role, content, user_id (null: the chat's owner); owners: (chat, owner). The owner is a participant even without a row.
    """
    own = messages.join(owners.select(chat, "owner"), chat, "left").withColumn("_who", F.coalesce("user_id", "owner"))
    seen = own.where("role = 'user'").select(chat, "_who").unionByName(owners.select(chat, F.col("owner").alias("_who"))).where("_who is not null")
    many = seen.groupBy(chat).agg(F.count_distinct("_who").alias("_n")).where("_n > 1").select(chat, F.lit(True).alias("_many"))
    name = F.when(F.col("_many") & (F.col("role") == "user"), T.safe_name(F.col("_who")))
    return own.join(many, chat, "left").select(chat, "id", "role", "content", name.alias("name"))


def speaker_lines(messages: DataFrame, owner: str, character: str) -> DataFrame:
    """``[time] speaker: content``; blank contents are dropped."""
    speaker = F.when(F.col("role") == "assistant", F.lit(character)).otherwise(F.coalesce("user_id", F.lit(owner)))
    moment = F.coalesce("occurred_at", "created_at")
    stamp = F.when(moment.isNotNull(), F.concat(F.lit("["), F.date_format(F.timestamp_seconds(moment), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z] "))).otherwise("")
    return messages.where(F.trim("content") != "").withColumn("line", F.concat(stamp, speaker, F.lit(": "), F.col("content")))


def dialogue_windows(turns: DataFrame, size: int = 6, context: int = 2, stride: int | None = None, doc: str = "chat_id", order: str = "turn", speaker: str = "role", text: str = "text") -> DataFrame:
    """(doc, window, speakers, text): windows of ``size`` turns every ``stride``, with the ``context`` turns before marked as such.

    A turn is copied to the windows that it belongs to, so the work is linear in turns.
    """
    stride = stride or size
    n = F.row_number().over(Window.partitionBy(doc).orderBy(order)) - 1
    numbered = turns.withColumn("_n", n)
    first = F.greatest(F.lit(0), F.ceil((F.col("_n") - size + 1) / stride)).cast("int")
    last = F.floor((F.col("_n") + context) / stride).cast("int")
    copies = numbered.withColumn("window", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))))
    copies = copies.withColumn("_own", F.col("_n") >= F.col("window") * stride)
    whole = copies.groupBy(doc, "window").agg(
        F.max("_own").alias("_any"),
        F.array_sort(F.collect_set(F.when(F.col("_own"), F.col(speaker)))).alias("speakers"),
        F.sort_array(F.collect_list(F.struct("_n", "_own", F.concat(F.col(speaker), F.lit(": "), F.col(text)).alias("line")))).alias("lines"),
    )
    said = lambda own: F.array_join(F.transform(F.filter("lines", lambda x: x["_own"] == own), lambda x: x["line"]), "\n")
    before = said(False)
    body = F.when(before == "", said(True)).otherwise(F.concat(F.lit("[context]\n"), before, F.lit("\n\n"), said(True)))
    return whole.where("_any").select(doc, "window", "speakers", body.alias("text"))


def message_counts(messages: DataFrame, chat: str = "chat_id") -> DataFrame:
    return messages.groupBy(chat).agg(F.count("*").alias("messages"))


def chats_listed(chats: DataFrame, user: str | None = None) -> DataFrame:
    """Chats, of a user or all, oldest first."""
    return (chats if user is None else chats.where(F.col("user_id") == user)).orderBy("created_at", "chat_id")


def rendered_message(content: Column, role: Column, user: Column, moment: Column, owner: str, character: str) -> Column:
    """``[time] speaker: content``; a user's turn without a name is the owner's, any other the character's."""
    who = F.when(role == "user", F.coalesce(F.nullif(F.trim(user), F.lit("")), F.lit(owner))).otherwise(F.lit(character))
    stamp = F.when(moment.isNotNull(), F.concat(F.lit("["), F.date_format(F.timestamp_seconds(moment), "yyyy-MM-dd'T'HH:mm:ss'+00:00'"), F.lit("]")))
    return F.concat_ws(" ", stamp, F.concat(who, F.lit(": "), content))


def transcripts(messages: DataFrame, owner: str, character: str, chat: str = "chat_id") -> DataFrame:
    """(chat, transcript, ids): what an extractor reads of a window of messages, blank ones left out, and the ids that its items may cite.

    A window is a handful of turns by construction (the trigger's), so a row holds one.
    """
    who = F.when(F.col("role") == "user", F.coalesce("user_id", F.lit(owner))).otherwise(F.lit(character))
    head = F.concat_ws(" / ", F.concat(F.lit("message_id="), F.col("id").cast("string")), F.concat(F.lit("occurred_at="), F.col("occurred_at").cast("string")))
    line = F.concat(F.lit("["), head, F.lit("] "), who, F.lit(": "), F.trim("content"))
    own = messages.where(F.trim("content") != "").groupBy(chat).agg(F.array_sort(F.collect_list(F.struct("id", line.alias("line")))).alias("x"))
    return own.select(chat, F.array_join(F.transform("x", lambda x: x["line"]), "\n").alias("transcript"), F.transform("x", lambda x: x["id"]).alias("ids"))


def cited(items: DataFrame, windows: DataFrame, chat: str = "chat_id") -> DataFrame:
    """Items whose provenance is cut to the ids of their window."""
    ids = windows.select(chat, F.col("ids").alias("_ids"))
    return items.join(ids, chat).withColumn("source_message_ids", F.array_intersect("source_message_ids", "_ids")).select(items.columns)


def unextracted_windows(messages: DataFrame, chat: str = "chat_id") -> DataFrame:
    """(chat, first_id, last_id, messages): what a full sweep extracts, a row per chat, the chat with the oldest open message first."""
    open_ = messages.where(~F.coalesce(F.col("extracted"), F.lit(False)))
    return open_.groupBy(chat).agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.count("*").alias("messages")).orderBy("first_id")


def evidence(rows: DataFrame, messages: DataFrame, revisions: DataFrame) -> DataFrame:
    """(id, message_id, role, content, revision): each remembered row beside the messages that it cites, others' turns left out, and beside its revisions; a row each, so no list grows with a hot row."""
    own = rows.select("id", F.col("user_id").alias("_owner"), F.explode("source_message_ids").alias("message_id"))
    m = messages.select(F.col("id").alias("message_id"), "role", "content", F.col("user_id").alias("_said"))
    seen = own.join(m, "message_id").where((F.col("role") != "user") | F.col("_said").isNull() | (F.col("_said") == F.col("_owner")))
    said = seen.select("id", "message_id", "role", "content", F.lit(None).cast("string").alias("revision"))
    none = {"message_id": F.lit(None).cast("long"), "role": F.lit(None).cast("string")}
    changed = revisions.join(rows.select("id"), "id", "left_semi").select("id", *[c.alias(n) for n, c in none.items()], "content", F.col("revision").cast("string").alias("revision"))
    return said.unionByName(changed)



def backfilled(rows: DataFrame, messages: DataFrame) -> DataFrame:
    """Rows (id, occurred_at, source_message_ids, ..) without a time get the moment of what they cite."""
    found = source_moment(rows.where(F.col("occurred_at").isNull()), messages).withColumnRenamed("moment", "_t")
    return rows.join(found, "id", "left").withColumn("occurred_at", F.coalesce("occurred_at", "_t")).select(rows.columns)
