"""Chat logs applied in order, greetings and closed memories against plain loops and fixed texts."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brainstate.functions import text as sc
from brainstate.operators import chat as ch
from brainstate.operators import chat_log

MESSAGES = "session_id string, turn long, role string, text string"
ACTIONS = "session_id string, seq long, what string, turn long, role string, text string"


def looped(messages, actions):
    """Each session's list after its actions, one after the other."""
    lists = {}
    for s, _, role, text in sorted(messages, key=lambda m: (m[0], m[1])):
        lists.setdefault(s, []).append((role, text))
    for s, _, what, turn, role, text in sorted(actions, key=lambda a: a[:3]):
        m = lists.setdefault(s, [])
        if what == "append":
            m.append((role, text))
        elif turn is not None and turn >= 0:
            if what == "edit" and text is not None and text.strip():
                lists[s] = [*m[:turn], ("user", text)]
            elif what == "delete" and turn < len(m):
                m.pop(turn)
    return sorted((s, i, *m) for s, ms in lists.items() for i, m in enumerate(ms))


ACTION = st.tuples(
    st.sampled_from("abc"), st.sampled_from(["edit", "edit", "delete", "delete", "append"]),
    st.one_of(st.none(), st.integers(-1, 12)), st.sampled_from(["x", " y ", " \t", "　"]),
)


@settings(max_examples=7, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(ACTION, max_size=30), st.integers(0, 9), st.integers(0, 700), st.sampled_from([3, 256]))
def test_log_equals_the_loop(spark, made, n_a, n_b, cut):
    messages = [(s, i, "user" if i % 2 else "assistant", f"{s}{i}") for s, n in (("a", n_a), ("b", n_b), ("d", 2)) for i in range(n)]
    actions = [(s, k, what, turn, "assistant", text) for k, (s, what, turn, text) in enumerate(made)]
    before, chat_log.CUT = chat_log.CUT, cut
    try:
        got = chat_log.apply_log(spark.createDataFrame(messages, MESSAGES), spark.createDataFrame(actions, ACTIONS)).collect()
    finally:
        chat_log.CUT = before
    assert sorted(map(tuple, got)) == looped(messages, actions)


def test_several_edits_and_deletions(spark):
    messages = spark.createDataFrame([("s", i, "user", f"m{i}") for i in range(5)], MESSAGES)
    edits = spark.createDataFrame([("s", 1, "one", 0), ("s", 3, "three", 1), ("s", 99, "far", 2)], "session_id string, turn int, new_text string, seq int")
    made = ch.edit_and_truncate(messages, edits).orderBy("turn").collect()
    assert [(r.turn, r.text) for r in made] == [(0, "m0"), (1, "one"), (2, "three"), (3, "far")]
    gone = spark.createDataFrame([("s", 1), ("s", 3), ("s", 3), ("s", 7)], "session_id string, turn int")
    assert [r.text for r in ch.delete_message(messages, gone).orderBy("turn").collect()] == ["m0", "m2", "m4"]
    ordered = gone.withColumn("seq", F.monotonically_increasing_id())
    assert [(r.turn, r.text) for r in ch.delete_message(messages, ordered).orderBy("turn").collect()] == [(0, "m0"), (1, "m2"), (2, "m3")]
    again = spark.createDataFrame([("s", 0, "user", "same"), ("s", 0, "user", "same"), ("t", 0, "user", "new")], "session_id string, seq int, role string, text string")
    made = sorted(ch.append_message(messages, again).filter("turn > 4 or session_id = 't'").collect())
    assert [tuple(r) for r in made] == [("s", 5, "user", "same"), ("s", 6, "user", "same"), ("t", 0, "user", "new")]


def test_greeting_where_the_id_was_used_before(spark):
    sessions = spark.createDataFrame(
        [("u", "session_41", 1, "t"), ("v", "session_7", 1, "t"), ("v", "session_8", 2, "t"), ("w", "session_1", 1, "t")],
        "user_id string, session_id string, session_order long, title string",
    )
    users = spark.createDataFrame([("u", "session_41", 40), ("v", "session_8", 8), ("w", "session_1", 9)], "user_id string, current_session_id string, session_counter int")
    gone = sessions.filter("user_id = 'u' or session_id = 'session_8'").select("user_id", "session_id")
    left = ch.delete_session(sessions, gone, users)
    assert sorted((r.user_id, r.session_id, r.is_new, r.is_current) for r in left.collect()) == [
        ("u", "session_41", True, True), ("v", "session_7", False, True), ("w", "session_1", False, True),
    ]
    assert [tuple(r) for r in ch.greeting_messages(left).collect()] == [("u", "session_41", 0, "assistant", "你好！开启了新的认知检索会话。")]


def test_closed_memory_is_the_fixed_text(spark):
    at = [dt.datetime(2024, 3, 1, 10, 37, 9), dt.datetime(2024, 3, 1, 10, 38, 46)]
    df = spark.createDataFrame([(*at, "Joyful_Happy (愉悦/开心/积极)", "等待 [状态持续中...] 结束", 96)], "a timestamp, b timestamp, s string, advice string, n long")
    opened = df.withColumn("open", sc.memory_text_open(F.col("s"), F.col("a"), F.col("advice")))
    r = opened.withColumn("closed", sc.memory_text_close(F.col("open"), F.col("b"), F.col("n"))).first()
    head = "【状态】: Joyful_Happy (愉悦/开心/积极)\n【开始时间】: 2024年03月01日 10时37分09秒\n【当时AI分析/环境推断】: 等待 [状态持续中...] 结束\n"
    assert r.open == head + "【结束时间】: [状态持续中...]"
    assert r.closed == head + "【结束时间】: 2024年03月01日 10时38分46秒\n【持续总时长】: 1分36秒"
