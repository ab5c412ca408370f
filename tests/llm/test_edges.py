"""Edge cases of the training-data operators, and checks against brute force where SQL can't express them."""

import html
import json
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bpe_codec, embedding_dedup, html_main, merkle, minhash_dedup, mixing, quality, queries, sharding, token_count, tool_calls

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CALLS = "conv_id long, turn long, role string, text string, conv int, kind string"
SMALL = "/root/testdata/sf0.001"


def call(*found):
    return json.dumps({"tool_calls": [dict(zip(("id", "name", "arguments"), x, strict=True)) for x in found]})


def linked(spark, rows, schemas=None):
    return tool_calls.link(spark.createDataFrame([(*r, 1, "y") for r in rows], CALLS), schemas).collect()


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    ranks, tokenizer = (public_tokenizers.path(f"byte_bpe_50k.{e}") for e in ("tiktoken", "json"))
    model = quality.train(docs, spark.createDataFrame([], "doc_id long, g int"), F.col("g"))
    results = [
        embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>")), quality.classify(docs, model, 2), sharding.place(docs),
        minhash_dedup.near_duplicates(docs), tool_calls.link(spark.createDataFrame([], CALLS)), merkle.edit_report(docs),
        html_main.extract(spark.createDataFrame([], "page_id long, url string, html string")), token_count.count_tokens(docs, tokenizer), mixing.mix(docs), bpe_codec.encode_decode(docs, ranks),
    ]
    assert [r.count() for r in results] == [0] * 10


def test_tool_calls_odd_json(spark):
    schemas = {"f": {"type": "object", "properties": {"x": {"type": "integer"}}}}
    rows = [
        (1, 0, "assistant", '{"tool_calls": [{"id": "a\\ud800", "name": "f", "arguments": {"x": "\\ud83d \\ud83d\\ude00"}}]}'),
        (1, 1, "system", '{"tool_calls": [{"id": "b", "name": "f", "arguments": {"x": 1e999}}]}'), (1, 2, "system", '{"tool_calls": [{"id": "c", "name": "f", "arguments": {"x": NaN}}]}'),
        (1, 3, "assistant", call(("d", "f", '{"x": Infinity}'), ("e", "f", {"x": 2.0}), ("g", "f", {"x": 2.5}))), (1, 4, "system", "[" * 100_000),
        (1, 5, "tool", '{"tool_call_id": "a\\ud800", "content": "\\udfff"}'), (1, 6, "system", '{"tool_calls": "none"}'), (1, 7, "user", "x" * 300_000),
        (2, 0, "system", '{"tool_calls": [{"id": "z", "name": "f", "arguments": ' + '{"x":' * 20_000 + "1" + "}" * 20_000 + "}]}"),
    ]
    got = {(r["conv_id"], r["turn"], r["part"]): r for r in linked(spark, rows, schemas)}
    assert got[1, 0, 0]["linked"] and got[1, 0, 0]["call_id"] == "a�" and not got[1, 0, 0]["valid"]
    assert json.loads(got[1, 0, 0]["json"])["arguments"] == {"x": "\ud83d \U0001f600"}
    assert got[1, 1, 0]["kind"] == got[1, 2, 0]["kind"] == got[1, 4, 0]["kind"] == got[1, 6, 0]["kind"] == got[2, 0, 0]["kind"] == "message"
    assert [got[1, 3, k]["valid"] for k in range(3)] == [False, True, False]
    for r in got.values():
        json.loads(r["json"], parse_constant=lambda c: pytest.fail(c))


def test_tool_calls_repeated_rows_have_one_owner(spark):
    rows = [(1, 0, "assistant", call(("a", "f", {})))] * 3 + [(1, 1, "tool", '{"tool_call_id": "a", "content": "1"}')] * 2 + [(None, 0, "assistant", call(("a", "f", {}))), (1, None, "assistant", call((None, "f", {})))]
    got = linked(spark, rows, {"f": {}})
    assert len(got) == 7 and sum(r["linked"] for r in got if r["kind"] == "call") == 1 and sum(r["linked"] for r in got if r["kind"] == "result") == 2


def test_tool_calls_long_chain_equals_brute_force(spark):
    rng = random.Random(4)
    n = 5000
    refs = {k: [k - 1] for k in range(1, n)} | {0: []}
    rows = [(1, k, "assistant", call((f"c{k}", "f", {"x": [f"$ref:c{j}" for j in refs[k]]}))) for k in range(n)]
    wide = {k: sorted({rng.randrange(max(0, k - 20), k) for _ in range(rng.randrange(4))}) if k else [] for k in range(24)}
    turn = {k: rng.randrange(50) for k in wide}
    rows += [(2, turn[k], "assistant", call((f"c{k}", "f", {"x": [f"$ref:c{j}" for j in wide[k]]}))) for k in wide]
    rows += [(3, 0, "assistant", call(("p", "f", "$ref:q"), ("q", "f", "$ref:r"), ("r", "f", "$ref:p"), ("s", "f", "$ref:p"), ("t", "f", {})))]
    got = {(r["conv_id"], r["call_id"]): r for r in linked(spark, rows, {"f": {}})}
    assert [got[1, f"c{k}"]["depth"] for k in (0, 1, 2, 4999)] == [0, 2, 4, 9998]
    depth, at = {}, {}
    for k in wide:
        depth[k] = max((depth[j] + 1 for j in wide[k]), default=0)
        at[k] = max([turn[k], *(at[j] for j in wide[k])])
        assert (got[2, f"c{k}"]["depth"], got[2, f"c{k}"]["order_turn"]) == (2 * depth[k], at[k])
    assert [got[3, x]["depth"] for x in "pqrst"] == [None, None, None, None, 0]


def test_ratings_without_both_marks_are_none(spark):
    marks = [(1, None, None), (2, 1, None), (3, None, 1), (4, 1, 0), (5, 0, 0), (6, 1, 1), (7, 0, 1)]
    rows = spark.createDataFrame(marks, "doc_id long, quality int, toxic int").select("doc_id", queries.grade().alias("g")).collect()
    assert {r["doc_id"]: r["g"] for r in rows} == {1: None, 2: None, 3: None, 4: 2, 5: 0, 6: 1, 7: 0}
    docs = spark.createDataFrame([(k, None if k == 4 else f"text {k}", "en", "s", 1) for k in range(9)], DOCS)
    number, count, grade = quality.rated(docs, spark.createDataFrame([*marks, (4, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int"), queries.grade())
    assert sorted(grade.tolist()) == [0, 0, 0, 1] and len(count) == 4


def test_classifier_scores_by_hand(spark):
    """classify gives the probabilities that weights and thresholds give when added up word by word."""
    rng = random.Random(3)
    docs = spark.createDataFrame([(k, " ".join(rng.choice(["good", "bad", "ok", "***", "Fine."]) for _ in range(rng.randrange(1, 30))), "en", "s", 1) for k in range(60)] + [(None, None, None, None, None)], DOCS)
    model = quality.train(docs, docs.select("doc_id", (F.length("text") % 3).alias("g")), F.col("g"))
    got = {r["doc_id"]: r for r in quality.classify(docs, model, 2).collect()}
    for doc in docs.collect():
        raw = np.frombuffer((doc["text"] or "").encode(), np.uint8)
        number, _ = quality.features(raw, np.array([0, len(raw)]))
        score = sum(float(model.weights[k]) for k in number)
        tails = [1 / (1 + np.exp(t - score)) for t in model.thresholds]
        assert got[doc["doc_id"]]["tail"] == pytest.approx(tails[1], abs=1e-6) and got[doc["doc_id"]]["expected_grade"] == pytest.approx(sum(tails), abs=1e-6)
    assert list(model.grades) == [0, 1, 2]


PAGES = [
    ("<p>one two three four five, six.</p><svg class='i'/><p>seven eight nine, ten eleven twelve.</p>", ["one two three four five, six.", "seven eight nine, ten eleven twelve."]),
    ("<div><p>First words, of the text.</p><iframe src=x></div><p>Later words, of the same text.</p>", ["First words, of the text.", "Later words, of the same text."]),
    ("<p>The sum <math><mi>x</mi><mo>+</mo><mn>1</mn></math> is large, they say.</p>", ["The sum x+1 is large, they say."]),
    ("<p title=it's>Quoted, with care, it is.</p><p title='a>b' lang=\"c>d\">And more, of it.</p>", ["Quoted, with care, it is.", "And more, of it."]),
    ("<p>Before, it was.</p><script>if (a < b) { s = '</p>' }</script><style>p{}</style><p>After, it is.</p>", ["Before, it was.", "After, it is."]),
    ("<p>A&nbsp;B &lt;c&gt; &#x41;&eacute;</p><!-- <p>no</p> --><p>D</p>", ["A B <c> Aé", "D"]),
]


@pytest.mark.parametrize("body, blocks", PAGES)
def test_page_text_is_kept(body, blocks):
    """No block of a page's text is lost or holds markup before any choice is made."""
    page = html_main.parse(f"<html><body><article>{body}</article></body></html>")
    assert [t for _, t in page.blocks] == blocks


def test_pages_written_by_hand():
    """Pages unlike the made ones, in plain layouts whose article is beyond doubt."""
    story = ["The harbour was quiet that morning, and the fishermen stayed at home.", "Nobody could say why the boats, all forty of them, had been moved overnight.", "By noon, a letter arrived that explained everything; the mayor read it aloud."]
    paragraphs = "".join(f"<p>{p}</p>" for p in story)
    shells = [
        "<html><head><title>t</title></head><body><nav><a href=/>Home</a> <a href=/a>About</a></nav><main>{}</main><footer>&copy; 2020 Harbour News. All rights reserved.</footer></body></html>",
        "<body><div class=navbar><ul><li><a href=/>Home</a><li><a href=/b>News</a></ul></div><div id=content><article>{}</article></div><div class='sidebar'><h3>More</h3><ul><li><a href=/x>Other story</a></li></ul></div></body>",
        "<body><header><h2>Harbour News</h2></header><article class=post>{}</article><section class=comments><div class=comment><p>Great story, thank you!</p></div></section><div class='cookie-notice'>We use cookies. <button>OK</button></div></body>",
    ]
    texts = html_main.main_texts([s.format(paragraphs) for s in shells], html_main.trained())
    assert texts == ["\n".join(story)] * 3


def test_long_and_broken_pages(spark):
    many = "<article>" + "".join(f"<p>Sentence number {k}, of a very long page.</p>" for k in range(5000)) + "</article>"
    got = html_main.extract(spark.createDataFrame([(1, "u", many), (2, "u", "<div " * 5000), (3, "u", '<a href="x' + "<p>y" * 2000), (4, "u", "<p>open <b>bold <p>next")], "page_id long, url string, html string"))
    rows = {r["page_id"]: r for r in got.collect()}
    assert rows[1]["text"].count("\n") == 4999 and len(rows) == 4


def test_sources_without_words_keep_their_place(spark):
    rows = [(k, None if s == "a" else " ".join(["w"] * 4), "en", s, 1) for k, s in enumerate(["a"] * 3 + ["b"] * 10 + ["c"] * 10 + ["d"] * 10)]
    got = {r["source"]: r for r in mixing.mix(spark.createDataFrame(rows, DOCS)).collect()}
    assert {s: round(r["target"], 4) for s, r in got.items()} == {"a": 0, "b": 33.3333, "c": 66.6667, "d": 80.0}  # d is full; b and c share the rest 1 to 2


def test_a_source_of_repeated_rows_comes_near_its_target(spark):
    rows = [(1, "a b c d", "en", "hot", k) for k in range(1000)] + [(k, "x y", "en", "t", 0) for k in range(2000, 5000)]
    df = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(df).collect()
    for s in ("hot", "t"):
        own = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 4
    assert mixing.repeat(df).count() == sum(r["times"] for r in got)


def test_mixing_by_given_weights(spark):
    """Of a fraction, documents of greater weight are taken more often; very small weights don't change that targets are met."""
    rows = [(k, "a b", "en", "s", k) for k in range(6000)]
    df = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(df, weight=F.when(F.col("doc_id") % 4 < 2, 0.001).otherwise(0.02)).collect()
    assert abs(sum(r["taken"] for r in got) - got[0]["target"]) <= 2
    heavy, light = (np.mean([r["times"] for r in got if (r["doc_id"] % 4 >= 2) == x]) for x in (True, False))
    assert heavy > light


def test_first_differing_paragraph_is_where_the_edit_is(spark):
    rng = random.Random(8)
    rows = [(k, "\n".join(" ".join(f"w{rng.randrange(500)}" for _ in range(rng.randrange(1, 12))) for _ in range(rng.randrange(1, 15)))) for k in range(80)]
    got = {r["doc_id"]: r for r in merkle.edit_report(spark.createDataFrame([(k, t, None, None, None) for k, t in rows], DOCS)).collect()}
    for (k, t), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        cut = len(t) // 4
        edited = t[: len(t) - cut] + after[:cut]
        other = set(edited.split("\n"))
        assert got[k]["first_differing"] == next((i for i, p in enumerate(t.split("\n")) if p not in other), None)


def test_likeness_against_brute_force():
    """Up to SKETCH nodes the likeness is the Jaccard similarity of all nodes; above, an estimate near it."""
    rng = random.Random(2)
    for size, slack in ((20, 1e-9), (400, 0.2)):
        for _ in range(30):
            words = [f"w{rng.randrange(50)}" for _ in range(size)]
            other = [w if rng.random() > 0.1 else "new" for w in words]
            a, b = " ".join(words), " ".join(other)
            merkle_sketch, merkle.SKETCH = merkle.SKETCH, 10**6
            exact = merkle.likeness(*merkle.fingerprints([a, b]))
            merkle.SKETCH = merkle_sketch
            assert merkle.likeness(*merkle.fingerprints([a, b])) == pytest.approx(exact, abs=slack)


def test_registered_queries(spark):
    """Every query runs over its whole table and has its contract's columns first."""
    columns = {
        "op1": "vec_id n_links component_id kept", "op4": "doc_id n_shingles component_id kept", "op6": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next", "op7": "page_id url text n_chars",
        "op8": "doc_id n_bytes n_tokens over_limit", "op9": "doc_id size source_size target taken", "op10": "doc_id n_tokens ids_sha256 decoded_sha256",
    }
    tables = {"op1": "embeddings", "op5": "conversations", "op7": "pages"}
    for name, query in queries.queries().items():
        op = name.split("_")[0]
        got = query(spark, SMALL)
        if op in columns:
            assert got.columns[: len(columns[op].split())] == columns[op].split()
        assert got.count() == spark.read.parquet(f"{SMALL}/{tables.get(op, 'documents')}.parquet").count()


def test_main_texts_have_no_markup(spark):
    got = queries.op7_html_extraction(spark, SMALL).collect()
    known = {r["page_id"]: html.unescape(re.sub(r"<[^>]*>", " ", r["html"] or "")) for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    for r in got:
        assert all(w in known[r["page_id"]] for w in r["text"].split()[:50])


def test_shards_are_written_whole(spark, tmp_path):
    rows = spark.createDataFrame([(k % 40 if k % 7 else None, f"t{k}", k, k, k) for k in range(200)], "doc_id long, text string, slot int, shard int, part int")
    sharding.write_shards(rows, str(tmp_path / "out"), files=2)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, got.select(rows.columns).collect()), key=repr) == sorted(map(tuple, rows.collect()), key=repr)
    placed = {r["doc_id"]: r["shard"] for r in sharding.place(rows).collect()}
    assert all(placed[r["doc_id"]] == r["_shard"] for r in got.collect())
    sharding.write_shards(rows.limit(0), str(tmp_path / "none"))
    with pytest.raises(ValueError):
        sharding.write_shards(rows.withColumn("_shard", F.lit(1)), str(tmp_path / "clash"))


def test_pipeline_stages_with_odd_rows(spark, tmp_path):
    """Null texts and labels, repeated and null ids, empty tables: every stage has a defined result."""
    import corpus_pipeline

    rng = random.Random(1)
    rows = [(k, " ".join(f"w{rng.randrange(90)}" for _ in range(40)) if k % 9 else None, "en", "s", 1) for k in range(60)] + [(None, "x y z", None, None, None), (5, "a b c", "en", "t", 3), (5, "a b c", "en", "t", 3)]
    docs = spark.createDataFrame(rows, DOCS)
    spark.createDataFrame([(k, k % 2 if k % 5 else None, 0) for k in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for table in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, str(tmp_path))
            assert name == "encoding" or out.columns == corpus_pipeline.COLUMNS
            kept = out.collect()
            known = {r["doc_id"] for r in table.collect()}
            assert {r["doc_id"] for r in kept} <= known
            if name == "encoding":
                assert len(kept) == table.count()
