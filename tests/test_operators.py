"""Closed forms, planted effects and their absence, gates, sources."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.api import Session
from tidemark.functions import text as X
from tidemark.operators import evidence, chunks, cluster, flow, influence, ledger, ranges, relations, select, sequences, stats
from tidemark.operators.select import QueryError
from tidemark.sources import adapters, canonical


def one(df):
    return df.collect()[0]


def test_ratio_closed_form(spark):
    s = spark.createDataFrame([("x", 20, 100, 10, 100)], "f string, a long, n1 long, c long, n0 long")
    r = one(stats.mantel_haenszel(s, ["f"]))
    assert r["rr"] == pytest.approx(2.0)
    assert r["lo"] == pytest.approx(0.987, abs=2e-3) and r["hi"] == pytest.approx(4.05, abs=0.02)
    r = one(stats.mantel_haenszel(spark.createDataFrame([("x", 9, 9, 482, 502)], s.schema), ["f"]))
    assert r["lo"] < 1 and r["rr"] == pytest.approx(0.990, abs=1e-3) and r["lo"] == pytest.approx(0.858, abs=1e-3) and r["hi"] == pytest.approx(1.143, abs=1e-3) and r["exposed_with"] == 9
    zero = one(stats.mantel_haenszel(spark.createDataFrame([("x", 0, 10, 3, 20)], s.schema), ["f"]))
    assert zero["exposed_with"] == 0 and 0 < zero["rr"] < 1


def test_wilson_and_tests(spark):
    low, high = stats.wilson(F.lit(0), F.lit(10))
    r = one(spark.range(1).select(low.alias("lo"), high.alias("hi")))
    assert r["lo"] == 0 and r["hi"] > 0.2
    assert stats.fisher(3, 1, 1, 3) == pytest.approx(0.4857, abs=1e-3)
    assert stats.poisson_tail(3, 1.0) == pytest.approx(1 - math.exp(-1) * 2.5)
    assert stats.two_sided(1.96) == pytest.approx(0.05, abs=1e-3)


def test_stretches_pause_and_span(spark):
    rows = [("a", 600 * k, k) for k in range(13)]  # every ten minutes: the span of an hour cuts
    s = sequences.stretches(spark.createDataFrame(rows, "actor string, t long, id long")).orderBy("start_t").collect()
    assert [r["n"] for r in s] == [7, 6]
    gaps = spark.createDataFrame([("a", 0, 1), ("a", 900, 2), ("a", 1801, 3)], "actor string, t long, id long")
    assert sorted(r["n"] for r in sequences.stretches(gaps).collect()) == [1, 2]


def test_reply_must_be_later(spark):
    e = spark.createDataFrame([("a", "b", 10, 1), ("b", "a", 10, 2), ("b", "a", 20, 3)], "src string, dst string, t long, event_id long")
    got = {r["event_id"]: r["r_id"] for r in relations.answered(e, 900).collect()}
    assert got == {1: 3, 2: None, 3: None}


def test_mentions_take_the_longest_name(spark):
    e = spark.createDataFrame([(1, "x", 0, "@GPT-5.1 and @gpt-5, not @GPT-5.2 nor @Lunar")], "id long, actor string, t long, text string")
    a = spark.createDataFrame([("gpt-5", "g5"), ("gpt-5.1", "g51"), ("luna", "l")], "alias string, id string")
    assert {r["dst"] for r in relations.mention_edges(e, a).collect()} == {"g5", "g51"}


@pytest.mark.parametrize("planted", [True, False])
def test_reaction_planted_and_null(spark, planted):
    rng = np.random.default_rng(1)
    rows, i = [], 0
    for actor in range(30):
        for day in range(10):
            for hour in range(0, 24, 2):
                rows.append((i := i + 1, actor, "chat", day * 86400 + hour * 3600))
            for _ in range(3):
                t = day * 86400 + int(rng.integers(0, 80000))
                rows.append((i := i + 1, actor, "ping", t))
                rows.append((i := i + 1, actor, "ack", t + int(rng.integers(120, 1200)) if planted else day * 86400 + int(rng.integers(0, 86400))))
    e = spark.createDataFrame(rows, "id long, actor long, kind string, t long")
    r = one(ranges.rates(ranges.reaction(e, F.col("kind") == "ping", F.col("kind") == "ack", 1200)))
    assert r["triggers"] == 900
    assert (r["rate"] > 0.6 and r["base"] < 0.2) if planted else r["rate"] < 0.3


def make_units(spark, n, days, chance, seed=3):
    rng = np.random.default_rng(seed)
    t = np.sort(rng.integers(0, days * 86400, n))
    units = spark.createDataFrame([(k, f"a{rng.integers(300)}", int(t[k])) for k in range(n)], "unit long, actor string, t long")
    has = [(k, "X") for k in range(n) if rng.random() < chance(t[k] / 86400)]
    return units, spark.createDataFrame(has, "unit long, feature string"), {k for k, _ in has}, rng


def test_flow_shared_trend_is_no_spread(spark):
    units, has, _, rng = make_units(spark, 2400, 56, lambda d: 0.05 + 0.4 * d / 56)
    edges = flow.earlier(spark.createDataFrame([(v, max(0, v - int(rng.integers(1, 60)))) for v in map(int, rng.integers(60, 2400, 6000))], "v long, u long"), units)
    r = one(flow.transmission(units, has, edges, flow.week_of(F.col("t"))))
    assert r["lo"] < 1 < r["hi"]
    assert one(flow.transmission(units, has, edges, F.lit(0)))["rr"] > r["rr"]


def test_flow_chain_is_one_cascade(spark):
    units = spark.createDataFrame([(k, f"a{k}", k * 100) for k in range(10)], "unit long, actor string, t long")
    has = spark.createDataFrame([(k, "X") for k in range(4)], "unit long, feature string")
    edges = spark.createDataFrame([(1, 0), (2, 1), (3, 2), (9, 3)], "v long, u long")
    r = flow.cascades(units, has, edges).collect()
    assert [(x["units"], x["actors"], x["depth"]) for x in r] == [(4, 4, 4)]


@pytest.mark.parametrize(("chance", "found"), [(lambda d: 0.1 if d < 15 else 0.6, 2), (lambda d: 0.3, 1)])
def test_regimes(spark, chance, found):
    units, has, _, _ = make_units(spark, 1500, 30, chance)
    r = flow.regimes(units, has)
    assert len(r) == found
    if found == 2:
        assert abs(r[1]["start_day"] - 15) <= 1


def test_influence_and_erasure(spark):
    units, has, shown, rng = make_units(spark, 3000, 20, lambda d: 0.2)
    edges = [(int(v), int(u)) for v, u in np.sort(rng.integers(0, 3000, (6000, 2)), axis=1)[:, ::-1] if v > u]
    carried = {v for v, u in edges if u in shown and rng.random() < 0.5}
    has = has.union(spark.createDataFrame([(v, "Y") for v in carried], "unit long, feature string"))
    links = {(r["f"], r["g"]): r for r in influence.links(units, has, spark.createDataFrame(edges, "v long, u long"), flow.week_of(F.col("t"))).collect()}
    assert links["Y", "X"]["passes"] and links["Y", "X"]["alpha"] > 1.2
    assert abs(links["X", "Y"]["alpha"]) < links["Y", "X"]["alpha"] / 2
    radius, total = influence.branching([("Y", "X", 0.4), ("X", "Y", 0.4)], {"X": 1.0, "Y": 1.0})
    assert radius == pytest.approx(0.4) and total is not None
    x = rng.standard_normal((600, 6))
    z = np.eye(3)[rng.integers(0, 3, 600)]
    x[:, 0] += z[:, 0]
    xc, zc = x - x.mean(0), z - z.mean(0)
    erased = xc @ cluster.erasure(600, xc.T @ xc / 600, xc.T @ zc / 600).T
    means = np.stack([erased[z[:, k] == 1].mean(0) for k in range(3)])
    assert np.abs(means).max() < 1e-8


def test_ledger_gates(spark):
    known = spark.createDataFrame([(1,), (2,)], "id long")
    book = ledger.Ledger()
    h = book.propose("more pings", "rate", ">", 0.5)
    with pytest.raises(QueryError):
        book.judge(h.id, "supported")
    book.measure(h.id, 0.4)
    book.add_evidence(h.id, [1, 99], known, True)
    assert [e["verified"] for e in h.evidence] == [True, False]
    with pytest.raises(QueryError):
        book.judge(h.id, "supported")
    assert book.judge(h.id, "rejected").status == "judged"


def test_patterns_and_names(spark):
    for bad in ("(a+)+", "(", "x" * 400):
        with pytest.raises(QueryError):
            select.safe_pattern(bad)
    with pytest.raises(QueryError):
        select.meta_field("a') OR 1=1 --")
    names = spark.createDataFrame([("1", "Ann"), ("2", "Anne")], "id string, label string")
    assert select.resolve_one(names, "ann") == "1"
    with pytest.raises(QueryError):
        select.resolve_one(names, "an")


def test_text_functions(spark):
    text = "see https://x.org/a/b?c=1, mail me@y.com; fixed PR 12 in run.py at 1a2b3c4d5e and github.com/o/repo-x"
    r = one(spark.createDataFrame([(text,)], "t string").select(X.artifacts(F.col("t")).alias("a"), X.cue(F.col("t"), "claim").alias("k"), X.shingles(F.lit("a b c"), 8).alias("s")))
    assert {"n:12", "f:run.py", "u:x.org/a/b", "c:1a2b3c4", "r:repo-x"} <= set(r["a"]) and r["k"] and r["s"] == []


def test_redaction_withholds_detail_and_keeps_plain_words(spark):
    cases = {
        "Total is 42 of 350 points, see 3.2.1.": "Total is 42 of 350 points, see 3.2.1.",
        "open https://example.org/a?q=1&x=%41%42%43 now": "open [link to example.org — details withheld] now",
        "posted at https://example.org": "posted at [link to example.org]",
        "x <script>alert(1)</script> y": "x [markup withheld] y",
        "ran `index.html` fine": "ran `index.html` fine",
        "mail jane.doe+x@mail.example.com or bot-5.1@agentvillage.org today": "mail [email withheld] or [email withheld] today",
        "see https://a.b/?to=x@y.com": "see [link to a.b — details withheld]",
    }
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", X.redact(F.col("t")).alias("r")).collect()
    assert {r["t"]: r["r"] for r in got} == cases
    r = one(spark.createDataFrame([("password: hunter2abc9", "`ls -la | grep secret`")], "a string, b string").select(X.redact(F.col("a")).alias("a"), X.redact(F.col("b")).alias("b")))
    assert "[secret withheld]" in r["a"] and "[command withheld]" in r["b"]
    nested = spark.createDataFrame([(("https://a.b/c?d=1", ["see https://a.b/c?d=1"]),)], "o struct<id:string,texts:array<string>>")
    r = one(nested.select(X.redact_value(F.col("o"), nested.schema["o"].dataType).alias("o")))["o"]
    assert r["id"] == "https://a.b/c?d=1" and r["texts"] == ["see [link to a.b — details withheld]"]


def test_shell_programs_and_requests(spark):
    cases = {
        "bash: cd /x && git push origin main": "git push", "Bash: gh pr create --title t": "gh pr create", "bash: FOO=1 timeout 30 python3 run.py | tail": "python3",
        "bash: cd /x && echo hi": None, "bash: data.json": None, "": None,
    }
    got = spark.createDataFrame([(k,) for k in cases], "c string").select("c", X.shell_program(F.col("c")).alias("p")).collect()
    assert {r["c"]: r["p"] for r in got} == cases
    urls = {
        "https://Host.org/a//b?x=1+or+1=1": ["requested: host.org", "request: query shaped like code injection", "request: unusual path (doubled slashes)"],
        "https://r.io/redirect?url=x&cb=12345": ["requested: r.io", "request: random tag that defeats caching", "request: routed through a redirect service"],
    }
    got = spark.createDataFrame([(k,) for k in urls], "u string").select("u", X.url_category(F.col("u")).alias("c")).collect()
    assert {r["u"]: r["c"] for r in got} == urls


def test_behaviours_and_numbers(spark):
    rows = [("message", "I fixed it, mail a@gmail.com", None, False), ("action", "x", "bash", False), ("result", "x", "bash", True), ("reasoning", "not sure", None, False)]
    got = spark.createDataFrame(rows, "k string, t string, tool string, e boolean").select(evidence.behaviours(F.col("k"), F.col("t"), F.col("tool"), F.col("e")).alias("b")).collect()
    assert [r["b"] for r in got] == [["said", "claims an outcome", "posts a personal e-mail address"], ["acted: bash"], ["failed: bash"], ["thought", "thought: doubts its work"]]
    assert one(spark.range(1).select(X.number_tokens(F.lit("1,200 of 3.5, and 7")).alias("n")))["n"] == ["1200", "3.5", "7"]
    assert evidence.lanes({("a", "b"): 1, ("b", "c"): 5, ("a", "d"): 3}, "a") == ["a", "d", "b", "c"]


def test_chunks_cover_every_event():
    pieces = chunks.split([k * 60 + (5000 if k > 6 else 0) for k in range(12)], [10] * 12, 200, 60)
    assert [i for a, b in pieces for i in range(a, b)] == list(range(12))
    assert all((b - a) * 10 <= 60 for a, b in pieces) and (0, 7) not in pieces


def test_log_folder(spark, tmp_path):
    lines = [{"id": "e1", "ts": "2024-01-01T10:00:00+02:00", "actor": "a", "to": "b", "text": "hi"}, {"id": "e2", "ts": "2024-01-01 09:00:00", "actor": "b"}]
    (tmp_path / "events.jsonl").write_text("\n\n".join(map(json.dumps, lines)))
    (tmp_path / "actors.jsonl").write_text(json.dumps({"id": "a", "label": "A", "kind": "agent"}))
    events, actors = canonical.load(spark, str(tmp_path))
    rows = {r["id"]: r for r in events.collect()}
    assert rows["e1"]["to"] == ["b"] and rows["e2"]["t"] - rows["e1"]["t"] == 3600 and rows["e2"]["kind"] == "message"
    assert {r["id"] for r in actors.collect()} == {"a", "b"}
    canonical.write_index(str(tmp_path / "index"), events=events)
    assert canonical.open_index(spark, str(tmp_path / "index"), ["events"])["events"].count() == 2
    assert canonical.open_work(spark, str(tmp_path), "tags").count() == 0
    canonical.put(spark, str(tmp_path), "k", '{"a":1}')
    assert canonical.get(spark, str(tmp_path), "k") == '{"a":1}' and canonical.get(spark, str(tmp_path), "none") is None
    (tmp_path / "events.jsonl").write_text(json.dumps({"id": "e1", "actor": "a"}) + "\n" + json.dumps({"id": "e3", "ts": "2024-01-01", "actor": "a", "kind": "odd"}))
    with pytest.raises(QueryError):
        canonical.load(spark, str(tmp_path))


def test_adapters(spark):
    revisions = spark.createDataFrame([(1, 10, "P", "a", "x\ny", "save"), (2, 20, "P", "b", "x\ny\nz", "save"), (3, 30, "P", "c", None, "delete")], "id long, t long, page string, actor string, body string, action string")
    got = {r["id"]: r for r in adapters.wiki_revisions(revisions).collect()}
    assert got[2]["text"] == "z" and got[3]["reply_to"] == 2
    captures = spark.createDataFrame([("1", 5, "http://h.org/a?tag=bob1", "404", "s"), ("2", 6, "http://h.org/b", "200", "s")], "id string, t long, url string, status string, section string")
    web = {r["id"]: r for r in adapters.web_captures(captures).collect()}
    assert web["1.r"]["failed"] and web["1.q"]["actor"] == "bob1" and web["2.q"]["actor"] == "unknown:s" and not web["2.r"]["failed"]


def test_tools(spark):
    e = spark.createDataFrame([(1, 0, "a", "ping", "c", "hello world", '{"k":1}', None), (2, 60, "b", "ack", "c", "world news", "{}", 1)], "id long, t long, actor string, kind string, channel string, text string, meta string, reply_to long")
    s = Session(e)
    assert s.call("search", query="world NOT news").count() == 1
    assert one(s.call("select_events", kind="ping"))["total"] == 1
    assert one(s.call("interactions"))["b_to_a"] == 1
    for bad in (lambda: s.call("nothing"), lambda: s.call("run_metric", metric="x"), lambda: s.call("run_metric", metric="burst", params={"q": 1}), lambda: s.call("overview", q=1)):
        with pytest.raises(QueryError):
            bad()


def test_empty_tables(spark):
    e = spark.createDataFrame([], "id long, actor string, kind string, channel string, t long")
    assert sequences.stretches(e).count() == 0 and relations.reply_edges(relations.with_reply_to(e)).count() == 0
    assert one(ranges.reaction(e, F.col("kind") == "a", F.col("kind") == "b", 60))["triggers"] == 0
