"""The training-data operators against brute force, exact round trips and held-out accuracy, and their defined edge cases."""

import hashlib
import json
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark.llm import bpe, bpe_codec, embedding_dedup, html_main, kernels, merkle, minhash_dedup, mixing, quality, sharding, token_count, tool_calls
from tidemark.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, rep int, a int"
JSON_FILE, RANK_FILE = (public_tokenizers.path(f"byte_bpe_50k.{e}") for e in ("json", "tiktoken"))


def prose(rng, n, vocabulary=3000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def frame(spark, texts, sources=None):
    rows = [(k, t, "en", (sources or {}).get(k, f"s{(k or 0) % 3}"), len(t or ""), "x", 1, 2) for k, t in texts]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    out = [(k, prose(rng, rng.randrange(1, 120))) for k in range(60)]
    for k in range(60, 140):  # near copies, with some words changed
        words = out[k % 20][1].split()
        for _ in range(rng.randrange(0, max(1, len(words) // 12))):
            words[rng.randrange(len(words))] = "changed"
        out.append((k, " ".join(words).title() if k % 3 else " ".join(words)))
    shared = prose(rng, 60)
    out += [(140 + k, shared + " " + prose(rng, 90)) for k in range(20)]
    out += [(200, None), (201, ""), (202, " \n\t"), (203, "one two"), (204, "ONE  two"), (205, "x" * 200_000), (206, "é ü 漢字 \U0001f600 <|endoftext|> isn't  it's\r\n"), (207, prose(rng, 20_000)), (None, "one two"), (0, out[0][1])]
    return out


def brute_groups(rows, percent=75):
    sets = {}
    for k, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(k for k in sets if sets[k])
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {k: (len(sets[k]), find(k)) for k in sets}


def test_minhash_groups_equal_brute_force(spark, texts):
    got = minhash_dedup.near_duplicates(frame(spark, texts)).collect()
    expected = brute_groups([(k, t) for k, t in texts if k is not None])
    assert len(got) == len(texts)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"] and r["n_shingles"] == 1
        else:
            assert (r["n_shingles"], r["component_id"]) == expected[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])


def test_minhash_dense_group(spark):
    rng = random.Random(8)
    base = prose(rng, 150).split()
    rows = []
    for k in range(300):
        words = list(base)
        for _ in range(rng.randrange(1, 7)):
            words[rng.randrange(len(words))] = f"v{rng.randrange(10**6)}"
        rows.append((k, " ".join(words)))
    got = {r["doc_id"]: r["component_id"] for r in minhash_dedup.near_duplicates(frame(spark, rows)).collect()}
    assert got == {k: c for k, (_, c) in brute_groups(rows).items()}


def thue_morse(n):
    """Two words of n letters that any polynomial hash modulo a power of two confuses once n is large enough."""
    one = "".join("ab"[bin(k).count("1") % 2] for k in range(n))
    return one, one.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [256, 1024])
def test_bytes_decide_not_hashes(spark, encoding, monkeypatch, n):
    words = thue_morse(n)
    rows = [(k, w) for k, w in enumerate(words)] + [(9, words[0].upper())]
    library = Tokenizer.from_file(JSON_FILE)
    for collide in (False, True):
        if collide:  # even if every hash of a task were the same
            monkeypatch.setattr(kernels, "segment_hash", lambda data, starts, lens, budget=0: np.full(len(starts), 7, np.uint64))
        import pyarrow as pa

        for _, _, data, offsets in kernels.chunks(pa.array([*words, "one two one two", *words])):
            starts, lens, _ = bpe.pre_tokens(data, offsets)
            first, _, inverse = kernels.distinct(data, starts, lens)
            raw = data.tobytes()
            found = [raw[s : s + k] for s, k in zip(starts, lens, strict=True)]
            assert [found[first[i]] for i in inverse] == found and len({found[f] for f in first}) == len(first)
    monkeypatch.undo()
    got = {r["doc_id"]: r["component_id"] for r in minhash_dedup.near_duplicates(frame(spark, rows)).collect()}
    assert got == {0: 0, 1: 1, 9: 0}
    counts = {r["doc_id"]: r["n_tokens"] for r in token_count.count_tokens(frame(spark, rows), JSON_FILE).collect()}
    assert counts == {k: len(library.encode(t, add_special_tokens=False).ids) for k, t in rows}
    ids = {r["doc_id"]: r["ids"] for r in bpe_codec.encode_decode(frame(spark, rows), RANK_FILE, keep_ids=True).collect()}
    assert ids == {k: encoding.encode_ordinary(t) for k, t in rows}


def test_minhash_recall_by_similarity(spark):
    """Pairs whose similarity spreads over 0.70 to 0.85, amid rewrites of one text that don't link: every link is found, and nothing else."""
    rng = random.Random(21)
    rows = []
    for k in range(400):
        base = prose(rng, 100, 10**6).split()
        at, n = rng.randrange(20, 60), rng.randrange(8, 18)
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(base[:at] + [f"x{k}y{j}" for j in range(n)] + base[at + n :]))]
    hub = prose(rng, 60).split()
    for k in range(300):
        words = list(hub)
        for j in rng.sample(range(60), 3):
            words[j] = f"z{rng.randrange(10**6)}"
        rows.append((1000 + k, " ".join(words)))
    got = {r["doc_id"]: r["component_id"] for r in minhash_dedup.near_duplicates(frame(spark, rows)).collect()}
    expected = {k: c for k, (_, c) in brute_groups(rows).items()}
    linked = [k for k in expected if expected[k] != k and k < 1000]
    assert 40 < len(linked) < 360
    assert got == expected


def test_bounds_drop_what_cannot_link(spark):
    """Of many rewrites with own words, the bounds leave a number in proportion to the rows, not to their square."""
    pairs = {}
    for n in (150, 600):
        rng = random.Random(5)
        hub = prose(rng, 60).split()
        members = []
        for k in range(n):
            words = list(hub)
            for j in rng.sample(range(60), 3):
                words[j] = f"z{rng.randrange(10**9)}"
            members.append((k, " ".join(words)))
        docs = frame(spark, members)
        heads = minhash_dedup.signatures(docs, "doc_id", "text").select(F.col("id").alias("rep"), F.col("s1").alias("s"), F.col("id").alias("c"), "n", "groups")
        pairs[n] = minhash_dedup._bounded(heads, docs, "doc_id", "text", 75, 5, 2).count()
    assert pairs[600] <= 4 * pairs[150] + 20


def test_components(spark):
    links = [(k + 1, k) for k in range(40)] + [(100, 101), (101, 102), (7, 7), (None, 3), (500, 499), (499, 500)]
    got = {r["id"]: r["component_id"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100, 102: 100, 499: 499, 500: 499}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("ab Z'stre\n\t  1.é漢"), st.characters(exclude_categories=["Cs"])), max_size=40), max_size=8))
def test_segment_kernels(texts):
    import pyarrow as pa

    for i, j, data, offsets in kernels.chunks(pa.array(texts, pa.string()), 16):
        starts, lens, owner = kernels.words(data, offsets)
        raw = data.tobytes()
        got = defaultdict(list)
        for s, n, o in zip(starts, lens, owner, strict=True):
            got[o].append(raw[s : s + n])
        for k in range(i, j):
            assert got[k - i] == re.findall(rb"[^\x20\x09-\x0D]+", texts[k].encode())
        starts, lens, count = bpe.pre_tokens(data, offsets)
        assert count.sum() == len(starts) and lens.sum() == len(data)


@pytest.fixture(scope="module")
def encoding():
    ranks = {t: k for k, t in enumerate(bpe.ranks_of(open(RANK_FILE, "rb").read()))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_token_counts_equal_the_library(spark, texts):
    library = Tokenizer.from_file(JSON_FILE)
    got = {r["doc_id"]: r for r in token_count.count_tokens(frame(spark, texts), JSON_FILE).collect()}
    for k, t in texts:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[k]["n_bytes"], got[k]["n_tokens"], got[k]["over_limit"]) == (len((t or "").encode()), n, n > 512)


def test_bpe_round_trip_equals_the_library(spark, texts, encoding):
    got = bpe_codec.encode_decode(frame(spark, texts), RANK_FILE, keep_ids=True).collect()
    assert len(got) == len(texts)
    known = {k: t or "" for k, t in texts}
    for r in got:
        text = known[r["doc_id"]]
        ids = encoding.encode_ordinary(text)
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["decoded"] == text
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_heap_is_linear_enough():
    merger, _ = bpe.merger_of_json(open(JSON_FILE, "rb").read())
    assert merger.count(b"ab" * 100_000) > 0


def test_embedding_links_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((900, 16))
    near = x[rng.integers(0, 60, 600)] + 0.12 * rng.standard_normal((600, 16))
    dense = x[0] + 0.02 * rng.standard_normal((300, 16))
    x = np.concatenate([x, near, dense, x[:40]])
    rows = [(k, [float(v) for v in r], 0, "x") for k, r in enumerate(x)]
    rows += [(9001, None, 0, ""), (9002, [0.0] * 16, 0, ""), (9003, [None] + [1.0] * 15, 0, ""), (9004, [float("nan")] + [1.0] * 15, 0, ""), (9005, [], 0, ""), (9006, [1.0, 2.0], 0, ""), (9007, [1.0, 2.0], 0, ""), (None, [1.0, 2.0], 0, "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, rep string")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    close = u @ u.T >= 0.95
    np.fill_diagonal(close, False)
    for options in ({}, {"leaf": 200, "target": 100, "sample": 800}):  # the second divides a dense leaf into blocks
        got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(df, **options).collect()}
        found = np.array([got[k]["n_links"] for k in range(len(x))])
        assert (found <= close.sum(1)).all()
        assert found.sum() >= 0.98 * close.sum()
        assert all(got[k]["n_links"] == 0 and got[k]["kept"] for k in (9001, 9002, 9003, 9004, 9005))
        assert got[9006]["n_links"] == 1 and got[9007]["component_id"] == 9006 and got[None]["kept"]
        assert got[1500]["component_id"] == 0 and got[1839]["component_id"] == got[39]["component_id"]


def test_quality_held_out_accuracy(spark):
    rng = random.Random(6)
    rows, marks = [], []
    for k in range(900):
        words = prose(rng, rng.randrange(20, 200), 400).split()
        kind = k % 3
        if kind == 0:
            words = [w + rng.choice(["***", "%%%", "&&&"]) for w in words] if k % 2 else words[:3] * 30
        elif kind == 1:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(["nasty", "awful"]) + rng.choice(["", ".", ","]))
        rows.append((k, " ".join(words)))
        marks.append((k, kind, "t"))
    docs = frame(spark, rows)
    labels = spark.createDataFrame(marks[:600], "doc_id long, g int, text string")
    model = quality.train(docs, labels, F.col("g"))
    assert list(model.thresholds) == sorted(model.thresholds) and model.grades == (0, 1, 2)
    got = {r["doc_id"]: r for r in quality.classify(docs, model, 2).collect()}
    right = sum(got[k]["kept"] == (k % 3 == 2) for k in range(600, 900))
    assert right >= 290
    mean = [np.mean([got[k]["expected_grade"] for k in range(600, 900) if k % 3 == g]) for g in range(3)]
    assert mean == sorted(mean)
    kept = {r["doc_id"] for r in quality.select(docs, model, 2).collect()}
    assert kept == {k for k, r in got.items() if r["kept"]}
    odd = frame(spark, [(None, None), (1, ""), (1, ""), (2, "x" * 100_000)])
    assert quality.classify(odd, model, 2).count() == 4
    empty = quality.train(docs, labels.limit(0), F.col("g"))
    assert quality.classify(odd, empty, 0).filter("kept").count() == 4


def test_shards_take_turns(spark):
    names = [f"n{k}" for k in range(7)]
    table = sharding.lookup_table(names, 101)
    assert set(Counter(table).values()) <= {14, 15}
    free, step = [None] * 101, [0] * 7
    orders = [[(sharding.number(f"offset:{n}") % 101 + j * (sharding.number(f"skip:{n}") % 100 + 1)) % 101 for j in range(101)] for n in names]
    for turn in range(101):  # plain: the next free slot of whoever's turn it is
        k = turn % 7
        slot = next(s for s in orders[k] if free[s] is None)
        free[slot] = k
    assert table == free
    fewer = sharding.lookup_table(names[:-1], 101)
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if a != 6)
    assert moved < 40
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (None, "d")], "doc_id long, slot string")
    got = sharding.place(rows).collect()
    assert len(got) == 4 and len({(r["doc_id"], r["shard"]) for r in got}) == 2
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 100)


def test_tool_calls(spark):
    call = lambda *c: json.dumps({"tool_calls": [dict(zip(("id", "name", "arguments"), x, strict=True)) for x in c]})
    rows = [
        (1, 0, "assistant", call(("a", "add", {"x": 1}), ("b", "add", {"x": "$ref:a"}), ("c", "none", {}))),
        (1, 1, "tool", json.dumps({"tool_call_id": "b", "content": {"z": 1, "a": 2}})), (1, 2, "tool", json.dumps({"tool_call_id": "a", "content": "1"})),
        (1, 3, "tool", json.dumps({"tool_call_id": "zz", "content": None})), (1, 4, "user", "{broken"), (1, 5, None, None),
        (2, 0, "assistant", call(("p", "add", {"x": "$ref:q"}), ("q", "add", {"x": "$ref:p"}))), (None, None, "user", ""),
        (3, 0, "user", "hello"), (3, 1, "assistant", "world"), (1, 0, "assistant", call(("a", "add", {"x": 5}))),
    ]
    df = spark.createDataFrame([(*r, 1, "y") for r in rows], "conv_id long, turn long, role string, text string, conv int, kind string")
    schemas = {"add": {"type": "object", "required": ["x"], "properties": {"x": {"type": "integer"}}}} | tool_calls.REPLY
    got = tool_calls.link(df, schemas).collect()
    by = {(r["conv_id"], r["turn"], r["part"], r["call_id"]): r for r in got}
    a, b = by[1, 0, 0, "a"], by[1, 0, 1, "b"]
    assert b["linked"] and b["peer_turn"] == 1 and not b["valid"] and "type integer" in b["error"]
    assert b["depth"] > by[1, 2, 0, "a"]["depth"] > a["depth"]
    assert by[1, 0, 2, "c"]["error"] == "unknown tool" and not by[1, 3, 0, "zz"]["linked"]
    assert by[1, 1, 0, "b"]["json"] == '{"content":"{\\"a\\":2,\\"z\\":1}","id":"b","kind":"result","linked":true,"role":"tool","turn":1}'
    assert by[2, 0, 0, "p"]["depth"] is None and by[2, 0, 1, "q"]["depth"] is None
    assert by[3, 0, 0, "3:0"]["linked"] and by[3, 1, 0, "3:0"]["order_turn"] == 1 and by[3, 0, 0, "3:0"]["valid"]
    order = [(r["kind"], r["call_id"]) for r in sorted((r for r in got if r["conv_id"] == 1 and r["linked"]), key=lambda r: (r["order_turn"], r["depth"], r["turn"], r["part"]))]
    assert order.index(("result", "a")) < order.index(("call", "b")) < order.index(("result", "b"))
    assert tool_calls.link(df.limit(0), schemas).count() == 0


def test_merkle(spark, texts):
    rows = [(k, t) for k, t in texts if k is not None]
    got = {(r["doc_id"], r["edited_sha256"]): r for r in merkle.edit_report(frame(spark, rows)).collect()}
    ordered = sorted(rows, key=lambda r: (r[0], r[1] or ""))
    for (k, t), (_, following) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        t, following = t or "", following or ""
        cut = len(t) // 4
        edited = t[: len(t) - cut] + following[:cut]
        r = got[k, hashlib.sha256(edited.encode()).hexdigest()]
        assert r["n_chars"] == len(t) and r["fingerprint"] == merkle.fingerprints([t])[0] and r["edited_fingerprint"] == merkle.fingerprints([edited])[0]
        assert r["near_edited"] == merkle.likeness(r["fingerprint"], r["edited_fingerprint"]) and 0 <= r["near_next"] <= 1
        if t == edited:
            assert r["near_edited"] == 1
    text = "alpha beta\ngamma delta epsilon\n\nzeta eta theta"
    differ = lambda a, b: merkle.differing(*merkle.fingerprints([a, b]))
    assert differ(text, text) == ([], [])
    assert differ(text, text.replace("zeta", "ZETA")) == ([3], [3])
    assert differ(text, "new one\n" + text) == ([], [0])
    assert merkle.fingerprints(["a\n"]) != merkle.fingerprints(["a"])
    assert merkle.edit_report(frame(spark, [])).count() == 0 and merkle.edit_report(frame(spark, [(5, "abcdefgh")])).collect()[0]["near_next"] == 1
    assert {r["fingerprint"] for r in merkle.fingerprint(frame(spark, [(1, "x y"), (2, "x y"), (None, None)])).collect()} == {*merkle.fingerprints(["x y", ""])}


def test_html(spark):
    rng = random.Random(77)
    model = html_main.trained()
    right = 0
    for _ in range(60):
        source, main = html_main.made_page(rng)
        right += set(html_main.main_texts([source], model)[0].split("\n")) == main
    assert right >= 54
    page = '<html><body><nav><a href="/">Home</a></nav><article><h1>A &amp; B</h1><p>One  two&nbsp;three<br>four <b>five</b>.<p>Second paragraph, open &lt;tag&gt; here.</article><footer>&copy; me</footer>'
    deep = "<div>" * 3000 + "x"
    rows = [(1, "u", page, "x"), (1, "u", page, "x"), (None, None, None, "x"), (3, "u", "", "x"), (4, "u", deep, "x"), (5, "u", "<<>< <p", "x"), (6, "u", "plain", "x")]
    got = html_main.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(got) == 7
    assert [r["text"] for r in got if r["page_id"] == 1] == ["A & B\nOne two three four five.\nSecond paragraph, open <tag> here."] * 2
    assert all(r["text"] == "" and r["n_chars"] == 0 for r in got if r["page_id"] in (None, 3))


def test_decoding_keeps_no_node_in_a_dropped_one():
    page = html_main.parse("<body><div><p>a</p></div><div><p>b</p></div></body>")
    odds = np.array([5.0] * len(page.tags))
    odds[2] = -9
    keep = html_main.decode(page, odds)
    assert not keep[2] and not keep[3] and keep[4] and keep[5]


def brute_targets(sizes, share=1.5, epochs=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    total, full = share * sum(sizes.values()), set()
    while True:
        left = total - sum(epochs * sizes[s] for s in full)
        free = sum(weight[s] for s in names if s not in full)
        out = {s: epochs * sizes[s] if s in full else left * weight[s] / free for s in names}
        new = {s for s in names if s not in full and out[s] > epochs * sizes[s]}
        if not new:
            return out
        full |= new


def test_mixing(spark):
    rng = random.Random(3)
    rows = [(k, prose(rng, rng.randrange(1, 60))) for k in range(3000)]
    sources = {k: None if k % 97 == 0 else "hot" if k % 3 == 0 else f"s{k % 11}" for k in range(3000)}
    rows += [(3000, None), (3001, ""), (3002, prose(rng, 4000)), (7, rows[7][1])]
    df = frame(spark, rows, sources)
    for bucket in (2000, 50):
        mixing.BUCKET = bucket
        got = mixing.mix(df).collect()
        sizes, taken, target = Counter(), Counter(), {}
        for r in got:
            sizes[r["source"]] += r["size"]
            taken[r["source"]] += r["taken"]
            target[r["source"]] = r["target"]
            assert r["taken"] <= 2 * r["size"]
        expected = brute_targets(sizes)
        for s, x in expected.items():
            assert target[s] == pytest.approx(x, abs=1e-5)
            assert abs(taken[s] - x) <= max(r["size"] for r in got if r["source"] == s)
        again = mixing.mix(df.repartition(7)).collect()
        assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)
        assert mixing.repeat(df).count() == sum(r["times"] for r in got)
    # with one source the order is that of the keys
    one = [r for r in got if r["source"] == "hot"]
    keys = {r["id"]: r["es"] for r in mixing.keyed(df, "doc_id", "source", "text").collect()}
    level = sorted((keys[r["doc_id"]], r["times"]) for r in one if r["size"])
    assert [t for _, t in level] == sorted((t for _, t in level), reverse=True)
    assert mixing.mix(df.limit(0)).count() == 0


def test_pipeline_stages(spark, tmp_path, encoding):
    rng = random.Random(9)
    rows = []
    for k in range(400):
        words = prose(rng, rng.randrange(30, 90), 300).split()
        rows.append((k, " ".join(w + "***" for w in words) if k % 4 == 0 else " ".join(words)))
    rows += [(400 + k, rows[k][1]) for k in range(60)]
    documents = frame(spark, rows).select(corpus_pipeline.COLUMNS)
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(k % 4 != 0), 0) for k in range(0, 400)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = documents, []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append(docs.collect())
        if name != "encoding":
            assert docs.columns == corpus_pipeline.COLUMNS
    good = {k for k, t in rows if "***" not in t}
    assert {r["doc_id"] for r in seen[0]} == good
    assert {r["doc_id"] for r in seen[1]} == {k for k, (_, c) in brute_groups([r for r in rows if r[0] in good]).items() if k == c}
    text = dict(rows)
    assert Counter((r["doc_id"], r["decoded_sha256"]) for r in seen[3]) == Counter((r["doc_id"], hashlib.sha256(text[r["doc_id"]].encode()).hexdigest()) for r in seen[2])
    assert all(r["n_tokens"] == len(encoding.encode_ordinary(text[r["doc_id"]])) for r in seen[3])
    assert Counter(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == Counter(map(tuple, seen[3]))


def test_sharding_sql(spark):
    import duckdb

    from tidemark.llm import queries

    con = duckdb.connect()
    con.execute("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    ours = queries.queries()["op3_sharding"](spark, "/root/testdata/sf0.001").select("doc_id", "slot", "shard", "shard_name").collect()
    assert sorted(map(tuple, ours)) == sorted(con.execute(f"select doc_id, slot, shard, shard_name from ({queries.SHARDING_SQL})").fetchall())
