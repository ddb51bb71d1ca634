"""Files, texts and chat defaults."""

import json

import numpy as np
from pyspark.sql import functions as F

from brainstate.functions import text as sc
from brainstate.functions.vectors import cosine_distance
from brainstate.operators import chat as ch
from brainstate.operators.pruned import asking, clustered
from brainstate.operators.retrieval import nearest_prior
from brainstate.plans import log_queries
from brainstate.sources import io
from compare import same

STORE = {
    "chat_sessions": {
        "session_2": {"title": "💬 b", "messages": [{"role": "assistant", "content": "你好"}, {"role": "user", "content": "x"}]},
        "session_1": {"title": "a", "messages": [{"role": "user", "content": "q"}]},
    },
    "session_counter": 2,
    "current_session_id": None,
}


def test_chat_store_round_trip(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(STORE, ensure_ascii=False, indent=2))
    store = io.read_chat_store(spark, str(tmp_path / "a.json"))
    rows = ch.flatten_sessions(store)
    assert [(r.session_id, r.turn, r.text) for r in rows.orderBy("session_order", "turn").collect()] == [
        ("session_2", 0, "你好"), ("session_2", 1, "x"), ("session_1", 0, "q"),
    ]
    assert ch.current_session(store).first().session_id == "session_1"
    io.write_chat_store(rows, str(tmp_path / "out"), 2, "session_1")
    again = ch.flatten_sessions(io.read_chat_store(spark, str(tmp_path / "out")))
    assert sorted(again.collect()) == sorted(rows.collect())


def test_missing_and_broken_store(spark, tmp_path):
    (tmp_path / "b.json").write_text("{not json")
    assert io.read_chat_store(spark, str(tmp_path / "none.json")).count() == 0
    assert io.read_chat_store(spark, str(tmp_path / "b.json")).count() == 0


def test_files_of_one_and_of_many_stores(spark, tmp_path):
    rows = [(s, k, f"s{k}", f"t{k}", i, "user", f"{s} {k}\n{i}") for s in range(7) for k in (2 * s, 2 * s + 1) for i in range(3)]
    written = spark.createDataFrame(rows, "store long, session_order long, session_id string, title string, turn long, role string, text string")
    out = tmp_path / "out"
    io.write_chat_store(written.coalesce(1), str(out), 1, None, "store")  # seven documents in a file
    (out / "one.json").write_text(json.dumps(STORE, ensure_ascii=False, indent=2))
    lines = [json.dumps({"chat_sessions": {k: {"title": k, "messages": [{"role": "user", "content": "m"}]}}}) for k in ("x", "y")]
    (out / "broken.json").write_text("\n".join([lines[0], "{not json", lines[1]]))
    got = ch.flatten_sessions(io.read_chat_store(spark, str(out))).select("session_id", "turn", "text").collect()
    expected = [(k, i, x) for _, _, k, _, i, _, x in rows] + [("x", 0, "m"), ("y", 0, "m"), ("session_2", 0, "你好"), ("session_2", 1, "x"), ("session_1", 0, "q")]
    assert sorted(map(tuple, got)) == sorted(expected)


def test_queries_of_many_stores(spark, tmp_path):
    rows = [(c, i, ("user", "assistant")[i % 2], f"{c} \n 你好 {i}") for c in range(0, 950, 7) for i in range(1 + c % 4)]
    said = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    said.toPandas().to_parquet(tmp_path / "conversations.parquet")
    for name in ("io3_read_chat_store", "io4_write_chat_store"):
        same(log_queries.QUERIES[name](spark, str(tmp_path)), log_queries.SQL[name], str(tmp_path))


def test_a_store_keeps_long_texts(spark, tmp_path):
    said = spark.range(2).select(
        F.lit(1).alias("session_order"), F.lit("s").alias("session_id"), F.lit("t").alias("title"), F.col("id").alias("turn"), F.lit("user").alias("role"),
        F.when(F.col("id") == 1, F.repeat(F.lit("é"), F.lit(20_000_001))).otherwise("short").alias("text"),
    )
    io.write_chat_store(said, str(tmp_path / "out"), 1, None)
    rows = ch.flatten_sessions(io.read_chat_store(spark, str(tmp_path / "out")))
    assert sorted(tuple(r) for r in rows.select("turn", F.length("text")).collect()) == [(0, 5), (1, 20_000_001)]


def test_chats_without_turn_or_id(spark, tmp_path):
    """In the SQL a message without turn comes last, and messages without conversation are one."""
    rows = [(c if c % 50 else None, None if i == c % 3 else i, None if i == 2 else "user", f"{c} {i}" if i else None) for c in range(1, 220) for i in range(4) if c % 50 or i]
    rows = [(c, i if c else k, r, x) for k, (c, i, r, x) in enumerate(rows)]  # no ties
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").toPandas().astype({"conv_id": "Int64", "turn": "Int64"}).to_parquet(tmp_path / "conversations.parquet")
    for name in ("io3_read_chat_store", "io4_write_chat_store", "ch1_flatten_sessions", "ch11_current_session"):
        same(log_queries.QUERIES[name](spark, str(tmp_path)), log_queries.SQL[name], str(tmp_path))


def test_clear_memory(spark, tmp_path):
    paths = [str(tmp_path / x) for x in ("eeg", "text")]
    rows = spark.sql("select 's' as session_id, 'e' as evt_id, array(1D) as vector, 'd' as document, 'c' as context, timestamp'2024-01-01' as start_ts")
    io.append_memory(rows, *paths)
    io.append_memory(rows, *paths)
    assert [spark.read.parquet(p).count() for p in paths] == [2, 2]
    io.clear_memory(spark, *paths)
    assert [spark.read.parquet(p).count() for p in paths] == [0, 0]
    assert spark.read.parquet(paths[0]).columns == ["session_id", "evt_id", "embedding", "context", "ts"]


def test_durations_and_json(spark):
    df = spark.createDataFrame([(32,), (92,), (0,)], "s long")
    assert [r[0] for r in df.select(sc.cn_duration(F.col("s"))).collect()] == ["32秒", "1分32秒", "0秒"]
    text = 'a"b\n你好 \\ 𝄞'
    row = spark.createDataFrame([(text,)], "t string").select(sc.json_string(F.col("t")).alias("j"), sc.speech_text(F.lit("*a[b]𝄞")).alias("s")).first()
    assert json.loads(row.j) == text
    assert row.s == " a b  "


def test_zero_vectors_match_nothing(spark):
    rows = [(1, 0, [0.0, 0.0]), (1, 1, [1.0, 0.0]), (1, 2, [2.0, 0.0]), (1, 3, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "session_id long, mem_seq long, vector array<double>")
    assert [(r.mem_seq, r.past) for r in nearest_prior(df).orderBy("mem_seq").collect()] == [(0, None), (1, None), (2, 1), (3, 1)]
    assert df.select(cosine_distance(F.col("vector"), F.col("vector")).alias("d")).first().d is None


def test_new_session_when_none_is_left(spark):
    sessions = spark.createDataFrame([("u", "s1", 1, "t")], "user_id string, session_id string, session_order long, title string")
    users = spark.createDataFrame([("u", "s1", 7)], "user_id string, current_session_id string, session_counter int")
    out = ch.delete_session(sessions, sessions.select("user_id", "session_id"), users).collect()
    assert [(r.session_id, r.title, r.is_current) for r in out] == [("session_8", ch.NEW_TITLE, True)]


def test_nearest_of_many_blocks_equals_brute_force(spark):
    r = np.random.default_rng(1)
    vectors = np.round(r.normal(size=(300, 5)), 1)
    vectors[r.integers(0, 300, 40)] = vectors[7]  # ties
    vectors[[3, 90]] = 0
    rows = [(int(i % 2), int(i), v.tolist()) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "session_id long, mem_seq long, vector array<double>")
    for block in (7, 2048):
        for x in nearest_prior(df, block=block).collect():
            past = [j for j in range(x.mem_seq) if j % 2 == x.session_id and vectors[j].any()] if vectors[x.mem_seq].any() else []
            d = {j: 1 - vectors[j] @ vectors[x.mem_seq] / np.linalg.norm(vectors[j]) / np.linalg.norm(vectors[x.mem_seq]) for j in past}
            assert (x.past is None) == (not past)
            if past:
                near = min(d.values())
                assert x.past == min(j for j in past if d[j] < near + 1e-12) and abs(x.distance - near) < 1e-12
    assert nearest_prior(df.limit(0)).count() == 0


def test_clusters_that_cannot_be_nearer_are_not_asked(spark):
    """Rows in tight bunches: nearly all of a row's comparisons fall away, and nothing that is found changes."""
    r = np.random.default_rng(4)
    bunches = r.normal(size=(12, 8))
    vectors = bunches[r.integers(0, 12, 1500)] + r.normal(size=(1500, 8)) * 0.01
    vectors[r.integers(0, 1500, 100)] = vectors[9]  # ties
    df = spark.createDataFrame([(1, i, v.tolist()) for i, v in enumerate(vectors)], "session_id long, mem_seq long, vector array<double>")
    u = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    d = np.round(1 - np.einsum("ik,jk->ij", u, u), 9)
    d[np.triu_indices(1500)] = np.inf
    got = {x.mem_seq: x.past for x in nearest_prior(df, block=50, digits=9).collect()}
    assert got == {i: int(d[i].argmin()) if i else None for i in range(1500)}
    rows = clustered(df.select("session_id", F.col("mem_seq").alias("seq"), F.col("vector").alias("v")), 50)
    best = spark.createDataFrame([(1, i, float(d[i].min())) for i in range(1, 1500)], "session_id long, seq long, d double")
    clusters = rows.select("cluster").distinct().count()
    asked = asking(rows, best, 9).count()
    assert clusters > 15 and asked < 0.2 * 1500 * clusters
