"""Adapters, exports and batches on small records whose result is plain to see."""

import json

from pyspark.sql import functions as F

from tidemark.sources import adapters, canonical


def test_chat_village(spark):
    messages = spark.createDataFrame([(1, 10, "a", "r1", "agent", "x"), (2, 20, "a", "r1", "agent", "y"), (3, 30, "a", "r2", "human", "z"), (4, 5, "b", "r1", "human", "w")], "id long, t long, actor string, room string, role string, text string")
    memories = spark.createDataFrame([("a", 1704067200, "old"), ("a", 1704153600, "new"), ("a", 1704844800, "next week")], "actor string, t long, text string")
    events, last = adapters.chat_village(messages, memories)
    assert {(r["id"], r["main_role"]) for r in events.collect()} == {(1, "agent"), (2, "agent"), (3, "agent"), (4, "human")}
    assert sorted((r["year"], r["week"], r["text"]) for r in last.collect()) == [(2024, 1, "new"), (2024, 2, "next week")]


def test_agent_transcript(spark, tmp_path):
    def row(i, at, *blocks):
        return {"id": i, "agent_id": "ag", "message_type": "m", "created_at": at, "content": {"message": {"content": list(blocks)}}}

    rows = [
        row("m2", "2024-01-01T00:00:20", {"type": "tool_result", "tool_use_id": "t1", "content": "boom", "is_error": True}),
        row("m1", "2024-01-01T00:00:10", {"type": "thinking", "thinking": "hm"}, {"type": "tool_use", "id": "t1", "name": "bash", "input": "ls"}, {"type": "tool_use", "id": "t2", "name": "bash", "input": "pwd"}),
        row("m1", "2024-01-01T00:00:30", {"type": "text", "text": "repeated id"}),
    ]
    (tmp_path / "log.jsonl").write_text("\n".join(map(json.dumps, rows)))
    got = {r["id"]: r for r in adapters.agent_transcript(spark.read.schema(adapters.TRANSCRIPT).json(str(tmp_path / "log.jsonl"))).collect()}
    assert {k: r["kind"] for k, r in got.items()} == {"m1.0": "reasoning", "m1.1": "action", "m1.2": "action", "m2.0": "result"}
    assert got["m2.0"]["reply_to"] == "m1.1" and got["m2.0"]["failed"]
    assert got["m1.1"]["failed"] and not got["m1.1"]["unanswered"] and got["m1.2"]["unanswered"]


def test_changes_only(spark):
    rows = spark.createDataFrame([(1, 1, "k", "a"), (2, 2, "k", "a"), (3, 3, "k", "b"), (4, 4, "k", "a")], "id long, t long, key string, goal string")
    assert [(r["id"], r["until"]) for r in adapters.changes_only(rows, "key", "goal").orderBy("t").collect()] == [(1, 3), (3, 4), (4, None)]


def test_other_boards(spark):
    posts = spark.createDataFrame([(1, "o1", "a", "2024-01-01", "u1", "x"), (2, "o2", "a", "02.01.2024 10:00", "u2", "x"), (3, "o2", "a", "soon", "u3", "x"), (4, "o2", "a", "soon", "u4", "x"), (5, "known", "a", "2024-01-01", "u5", "x")], "id long, origin string, actor string, when string, url string, text string")
    dated, rest = adapters.other_boards(posts, spark.createDataFrame([("known",)], "origin string"), spark.createDataFrame([("u3", 99), ("u3", 77)], "url string, t long"))
    assert {r["id"]: r["t"] for r in dated.collect()} == {1: 1704067200, 2: 1704189600, 3: 77}
    assert [r["id"] for r in rest.collect()] == [4]


def test_forum(spark):
    rows = spark.createDataFrame([(1, 5, "a", "Plan to: bob, carl-2", "hello"), (2, 6, "b", "no recipients", "x")], "id long, t long, author string, subject string, body string")
    assert {r["id"]: r["to"] for r in adapters.forum(rows).collect()} == {1: ["bob", "carl-2"], 2: []}


def test_batches_out_and_answers_in(spark, tmp_path):
    units = spark.createDataFrame([(1, "u1", "x"), (1, "u2", "y"), (2, "u3", "z")], "batch int, unit string, text string")
    adapters.write_batches(units, str(tmp_path / "b"))
    batches = spark.read.json(str(tmp_path / "b"))
    assert {(r["batch"], r["label"]): r["unit"] for r in batches.collect()} == {(1, "U1"): "u1", (1, "U2"): "u2", (2, "U1"): "u3"}
    answers = spark.createDataFrame([("j", 1, '[{"label": "U2", "feature": "f"}, {"label": "U9", "feature": "f"}]'), ("j", 2, "broken"), ("k", 2, '[{"label": "U1", "feature": "g"}]')], "judge string, batch int, json string")
    marks, counts = adapters.read_answers(answers, batches)
    assert {(r["judge"], r["unit"], r["feature"]) for r in marks.collect()} == {("j", "u2", "f"), ("k", "u3", "g")}
    assert {r["judge"]: (r["kept"], r["dropped"]) for r in counts.collect()} == {"j": (1, 1), "k": (1, 0)}


def test_export_and_split(spark, tmp_path):
    events = spark.range(100).select(F.col("id").cast("string").alias("id"), F.col("id").alias("t"))
    canonical.export_bundle(events, str(tmp_path / "bundle"), 4)
    assert spark.read.json(str(tmp_path / "bundle")).count() == 100
    train, test, work = canonical.split(events, {"tags": spark.createDataFrame([("3",), ("70",)], "event_id string")}, 50)
    assert train.count() == 50 and test.count() == 50 and [r["event_id"] for r in work["tags"].collect()] == ["3"]


def test_every_tool_runs(spark):
    from tidemark.api import Session
    from tidemark.operators import relations

    rows = [(str(k), f"a{k % 5}", ["ask", "answer", "note"][k % 3], f"c{k % 4}", k * 600, "text", "{}") for k in range(200)]
    events = relations.with_reply_to(spark.createDataFrame(rows, "id string, actor string, kind string, channel string, t long, text string, meta string"))
    session = Session(events)
    given = {"actor": "a1", "a": "ask", "b": "answer", "kind": "ask", "ids": ["3"], "channel": "c1"}
    for name in ("claim", "co_occurs", "spread", "reactions", "map", "node", "neighbourhood", "before", "started_stopped", "first_changes", "turning_points", "periods", "grain", "leads", "stretches", "lines", "ends", "sample"):
        session.call(name, **{k: v for k, v in given.items() if k in session.tools[name].arguments}).collect()
    one = session.call("claim", a="ask", b="answer", width=3600, scope="others_same_place").collect()[0]
    assert one["cases"] > 0 and one["verdict"] in ("holds", "not_holds", "insufficient")
    for metric, params in (("after_then", {"a": "ask", "b": "note"}), ("spread_with_base", {"kind": "ask"}), ("answered", {}), ("outliers", {}), ("channel_reaction", {"trigger": "ask", "response": "answer"})):
        assert session.call("run_metric", metric=metric, params=params).columns


def test_text_index_on_disk(spark, tmp_path):
    from tidemark.operators import reuse

    posts = spark.createDataFrame([(1, "The cat, the dog"), (2, "a dog the cat"), (3, None), (4, "")], "id long, text string")
    canonical.write_text_index(str(tmp_path), reuse.text_index(posts), 8)
    index = canonical.open_text_index(spark, str(tmp_path), ["the", "dog"], 8)
    assert {r["term"] for r in index.collect()} == {"the", "dog"}
    assert {r["id"]: r["hits"] for r in reuse.indexed(index, ["the", "dog"]).collect()} == {1: 2, 2: 1}
    assert {r["id"]: r["hits"] for r in reuse.indexed(index, ["the", "dog"], phrase=True).collect()} == {1: 1}
