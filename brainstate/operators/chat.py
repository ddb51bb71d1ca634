"""Chat logs (CH1 to CH11, PF8): messages are rows (session_id, turn, role, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brainstate.operators.chat_log import apply_log

#: Defaults of a new session.
NEW_TITLE = "💬 新对话"
GREETING = "你好！开启了新的认知检索会话。"
TITLE_MARK = "💬 "


def _w():
    return Window.partitionBy("session_id")


def role_messages(messages: DataFrame) -> DataFrame:
    """PF8: messages of user and assistant."""
    return messages.filter(F.col("role").isin("user", "assistant"))


def flatten_sessions(store: DataFrame) -> DataFrame:
    """CH1: one row for each message of a chat store, in the order of its sessions."""
    return (
        store.select(F.posexplode(F.map_entries("chat_sessions")).alias("session_order", "s"))
        .select("session_order", F.col("s.key").alias("session_id"), F.col("s.value.title").alias("title"), F.posexplode("s.value.messages").alias("turn", "m"))
        .select("session_order", "session_id", "title", F.col("turn").cast("long").alias("turn"), F.col("m.role").alias("role"), F.col("m.content").alias("text"))
    )


def recent_turns(messages: DataFrame, n: int = 4) -> DataFrame:
    """CH2: of the last n messages those of user and assistant."""
    back = F.row_number().over(_w().orderBy(F.desc("turn")))
    return role_messages(messages.withColumn("back", back).filter(F.col("back") <= n).drop("back"))


def pending_reply(messages: DataFrame) -> DataFrame:
    """CH3: sessions whose last message is a user's."""
    last = messages.groupBy("session_id").agg(F.max_by("role", "turn").alias("last_role"))
    return last.filter(F.col("last_role") == "user").select("session_id")


def chat_payload(messages: DataFrame) -> DataFrame:
    """CH4: (session_id, query, history) of pending sessions: the last text, and all messages before it."""
    all_of = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m")
    rows = messages.groupBy("session_id").agg(all_of).filter(F.element_at("m", -1)["role"] == "user")
    before = F.slice("m", F.lit(1), F.size("m") - 1)
    return rows.select(
        "session_id",
        F.element_at("m", -1)["content"].alias("query"),
        F.transform(before, lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("history"),
    )


def rag_prompt(payload: DataFrame, timelines: DataFrame, system: str = "{timeline}", n: int = 4) -> DataFrame:
    """CH5: (session_id, messages): the system text with the timeline, the recent history, and the query."""
    said = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    size = F.size("history")
    recent = F.slice("history", F.greatest(size - n + 1, F.lit(1)), F.lit(n))
    recent = F.filter(recent, lambda x: x["role"].isin("user", "assistant"))
    text = F.replace(F.lit(system), F.lit("{timeline}"), F.col("timeline"))
    return payload.join(timelines, "session_id").select(
        "session_id",
        F.concat(F.array(said("system", text)), recent, F.array(said("user", F.col("query")))).alias("messages"),
    )


def _in_turn(actions: DataFrame) -> DataFrame:
    """seq as long, 0 for all if actions have none."""
    return actions.withColumn("seq", (F.col("seq") if "seq" in actions.columns else F.lit(0)).cast("long"))


def edit_and_truncate(messages: DataFrame, edits: DataFrame) -> DataFrame:
    """CH6: edits (session_id, turn, new_text, perhaps seq) cut their session at turn and put the new text there; blank ones don't.

    Edits of one session are applied in the order of seq; past the end they append.
    """
    log = _in_turn(edits).select("session_id", "seq", F.lit("edit").alias("what"), "turn", F.lit("user").alias("role"), F.col("new_text").alias("text"))
    return apply_log(messages, log)


def delete_message(messages: DataFrame, deleted: DataFrame) -> DataFrame:
    """CH7: without the turns of deleted (session_id, turn, perhaps seq); later turns move up, also for the deletions that follow.

    Deletions of one session without seq go from its last turn to its first, each by the turn as it was.
    """
    rows = deleted.distinct() if "seq" not in deleted.columns else deleted
    rows = _in_turn(rows) if "seq" in deleted.columns else rows.withColumn("seq", -F.col("turn").cast("long"))
    none = F.lit(None).cast("string")
    return apply_log(messages, rows.select("session_id", "seq", F.lit("delete").alias("what"), "turn", none.alias("role"), none.alias("text")))


def delete_session(sessions: DataFrame, deleted: DataFrame, users: DataFrame) -> DataFrame:
    """CH8: sessions (user_id, session_id, session_order, title) left, with is_new and is_current.

    users: (user_id, current_session_id, session_counter). If the current session goes, the last one left takes
    over; a user with none left gets a new one with the next number.
    """
    left = sessions.join(deleted, ["user_id", "session_id"], "left_anti")
    last = left.groupBy("user_id").agg(F.max_by("session_id", "session_order").alias("last"), F.collect_set("session_id").alias("ids"))
    now = users.join(last, "user_id", "left").select(
        "user_id",
        F.when(F.array_contains("ids", F.col("current_session_id")), F.col("current_session_id"))
        .otherwise(F.coalesce("last", F.concat(F.lit("session_"), (F.col("session_counter") + 1).cast("string"))))
        .alias("now"),
        F.col("last").isNull().alias("empty"),
        (F.col("session_counter") + 1).cast("long").alias("next"),
    )
    new = now.filter("empty").select("user_id", F.col("now").alias("session_id"), F.col("next").alias("session_order"), F.lit(NEW_TITLE).alias("title"))
    new = new.withColumn("is_new", F.lit(True))
    rows = left.select("user_id", "session_id", F.col("session_order").cast("long").alias("session_order"), "title", F.lit(False).alias("is_new")).unionByName(new)
    return rows.join(now.select("user_id", "now"), "user_id").withColumn("is_current", F.col("session_id") == F.col("now")).drop("now")


def greeting_messages(sessions: DataFrame) -> DataFrame:
    """CH8: the first message (user_id, session_id, turn, role, text) of each session that delete_session has made.

    Its id may be one that was used before, and deleted.
    """
    return sessions.filter("is_new").select(
        "user_id", "session_id", F.lit(0).cast("long").alias("turn"), F.lit("assistant").alias("role"), F.lit(GREETING).alias("text")
    )


def session_title(messages: DataFrame) -> DataFrame:
    """CH9: (session_id, title) by the last user message that came while the session had one message at most."""
    first = messages.filter((F.col("role") == "user") & (F.col("turn") <= 1))
    text = first.groupBy("session_id").agg(F.max_by("text", "turn").alias("text"))
    short = F.when(F.length("text") > 12, F.concat(F.substring("text", 1, 12), F.lit("..."))).otherwise(F.col("text"))
    return text.select("session_id", F.concat(F.lit(TITLE_MARK), short).alias("title"))


def append_message(messages: DataFrame, new: DataFrame) -> DataFrame:
    """CH10: new (session_id, seq, role, text) at the next turns of their sessions."""
    log = _in_turn(new).select("session_id", "seq", F.lit("append").alias("what"), F.lit(None).cast("long").alias("turn"), "role", "text")
    return apply_log(messages, log)


def current_session(store: DataFrame) -> DataFrame:
    """CH11: the stored current session, or else the last one."""
    return store.select(F.coalesce("current_session_id", F.try_element_at(F.map_keys("chat_sessions"), F.lit(-1))).alias("session_id"))
