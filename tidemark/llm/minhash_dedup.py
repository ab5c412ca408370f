"""Near-duplicate documents by MinHash with tensored banding.

Two collections of ``tables`` short minhash groups are computed, 2 * tables * rows minhashes in all. The key of table (i, j)
joins group i of the first collection with group j of the second, so tables ** 2 tables cost the minhashes of 2 * tables.
At the threshold of 0.75, 12 and 2 give a pair a chance of 0.9999 to share a key, 0.99999 at 0.8.

Plan: one scan makes a small row for each document (set size, digest of its words, groups), cut to the checkpoint folder. Documents
with equal words are one class. A class whose groups are alone in one collection has no key to share and leaves; the others emit their
keys. Candidates are confirmed on the words of the whole texts, in three steps:

1. Every class with the least one of its buckets.
2. In buckets whose members are still in different components, every member with further centres, the least by other orders.
3. In buckets still open, the pairs that bounds can't exclude. A link needs minhashes and shingles that both documents have, so those held
   by one component only count for nothing: members are dropped as long as the minhashes left to them, then the shingles, are fewer than
   the threshold asks for (of minhashes, fewer than a pair at the threshold shares but with a chance of MISSED), and the shingles that
   remain are counted by ranges of their hashes. Two members meet only if the sum over ranges of the
   lesser counts allows the threshold; each pair in the first table it shares only. Bounds exclude no link.

Steps 1 and 2 make a number of pairs in proportion to the rows. So does step 3 on rewrites of one text that differ by own words; what it
compares beyond that are members whose common shingles come close to the threshold but don't reach it.

Before texts are fetched, a pair must pass two tests that need none: the sizes of the sets allow the threshold, and four bits of each
minhash differ in no more places than a pair at the threshold exceeds with a chance of MISSED.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .components import components
from .kernels import U64, chunks, int64, per_text, shingle_sets, splitmix, stream

SIGNATURE = "id long, n long, s1 long, s2 long, x1 long, x2 long, groups array<long>"
NIBBLES = 32
MISSED = 1e-5
CENTRES = 12
RANGES = 16
FEW = 2_000_000
MINHASH_PEELS = 2
SHINGLE_PEELS = 3


def allowed(percent: int, marks: int) -> int:
    """The least number of differing marks, of four bits each, that a pair at the threshold exceeds with a chance of MISSED at most."""
    differ, tail = (1 - percent / 100) * 15 / 16, 1.0
    for k in range(marks + 1):
        tail -= math.comb(marks, k) * differ**k * (1 - differ) ** (marks - k)
        if tail <= MISSED:
            return k
    return marks


def needed(percent: int, minhashes: int) -> int:
    """The number of equal minhashes that a pair at the threshold falls short of with a chance of MISSED at most."""
    share, below = percent / 100, 0.0
    for k in range(minhashes + 1):
        below += math.comb(minhashes, k) * share**k * (1 - share) ** (minhashes - k)
        if below > MISSED:
            return k
    return minhashes


def word_digest(raw: bytes) -> bytes:
    """A cryptographic digest, of 128 bits, of the words of a text without the case of A-Z."""
    return hashlib.blake2b(b" ".join(raw.lower().split()), digest_size=16).digest()


def _digests(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    raw = data.tobytes()
    return np.frombuffer(b"".join([word_digest(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]), "<i8").reshape(-1, 2)


def _signatures(width: int, tables: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 2 * tables * rows
        flip, odd = stream(31, total), stream(32, total) | U64(1)
        bits = 64 // rows
        mask = U64((1 << bits) - 1)
        for batch in batches:
            ids = batch.column(0)
            for i, j, data, offsets in chunks(batch.column(1)):
                sets, count = shingle_sets(data, offsets, width)
                some = count > 0
                groups = np.zeros((int(some.sum()), 2 * tables), U64)
                marks = np.zeros((2, j - i), U64)
                for k in range(total):
                    least = per_text(np.minimum, (sets ^ flip[k]) * odd[k], count)
                    groups[:, k // rows] |= (splitmix(least) & mask) << U64(bits * (k % rows))
                    if k < NIBBLES:
                        marks[k // 16, some] |= ((least >> U64(20)) & U64(15)) << U64(4 * (k % 16))
                digest = _digests(data, offsets)
                none = pa.array(~some)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(some * 2 * tables)]).astype(np.int32)), int64(groups.reshape(-1))
                )
                hidden = pa.scalar(None, pa.int64())
                parts = [ids.slice(i, j - i), int64(count)]
                parts += [pc.if_else(none, hidden, int64(s)) for s in (digest[:, 0], digest[:, 1], *marks)]
                yield pa.RecordBatch.from_arrays([*parts, lists], names=["id", "n", "s1", "s2", "x1", "x2", "groups"])

    return run


def signatures(documents: DataFrame, id_col: str, text_col: str, width: int = 5, tables: int = 12, rows: int = 2) -> DataFrame:
    """One row per document: id, n (size of its shingle set), s1 and s2 (digest of its words, null without words), x1 and x2 (four bits
    of each minhash), groups (2 * tables, each of rows minhashes side by side)."""
    slim = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(_signatures(width, tables, rows), SIGNATURE)


def _binary(texts: pa.Array) -> pa.Array:
    return texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary())


def word_shingles(raw: bytes, width: int) -> set[tuple[bytes, ...]]:
    """The distinct width-word shingles of a text without the case of A-Z; of fewer words, the whole sequence."""
    found = raw.lower().split()
    return set(zip(*(found[k:] for k in range(width)), strict=False)) if len(found) >= width else {tuple(found)} if found else set()


def _confirm(percent: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_text, held = None, set()
        for batch in batches:
            hits = np.zeros(batch.num_rows, bool)
            for r, (one, two) in enumerate(zip(_binary(batch.column(2)), _binary(batch.column(3)), strict=True)):
                one, two = one.as_py() or b"", two.as_py() or b""
                if one != held_text:
                    held_text, held = one, word_shingles(one, width)
                other = word_shingles(two, width)
                both = len(held & other)
                hits[r] = both > 0 and 100 * both >= percent * (len(held) + len(other) - both)
            keep = pa.array(hits)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return run


def _texts_of(ids: DataFrame, documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and text of the documents whose ids are asked for. Up to FEW ids, which are counted first, go to the scan, so that other texts stay where
    they are; beyond that texts meet ids by hash."""
    ids = cut(ids.distinct())
    texts = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return texts.join(F.broadcast(ids) if ids.count() <= FEW else ids.hint("merge"), "id", "left_semi")


def confirm(pairs: DataFrame, documents: DataFrame, id_col: str, text_col: str, percent: int = 75, width: int = 5) -> DataFrame:
    """The pairs (a, b) of ids whose whole texts' shingle sets have 100 * intersection >= percent * union, the words themselves compared.

    Only the texts that pairs ask for move. Both joins use one exchange of them; a side with many pairs is split by the adaptive skew join.
    """
    texts = _texts_of(pairs.select(F.col("a").alias("id")).union(pairs.select("b")), documents, id_col, text_col)
    first = pairs.hint("merge").join(texts.hint("merge"), F.col("b") == F.col("id")).select("a", "b", F.col("text").alias("text_b"))
    both = first.hint("merge").join(texts.hint("merge"), F.col("a") == F.col("id"))
    return both.select("a", "b", F.col("text").alias("text_a"), "text_b").mapInArrow(_confirm(percent, width), "a long, b long")


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in chunks(batch.column(1)):
                sets, count = shingle_sets(data, offsets, width)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), int64(sets))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), int64(_digests(data, offsets)[:, 0]), lists], names=["rep", "s", "sets"])

    return run


def _peel(rows: DataFrame, least: DataFrame | int) -> tuple[DataFrame, DataFrame]:
    """One round: of rows (m, c, h), those whose h members of other components c have too, and the members m left with as many as least says."""
    rows = rows.repartition("h")
    foreign = rows.groupBy("h").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low < high").select("h")
    rows = rows.join(foreign, "h", "left_semi")
    count = rows.groupBy("m").agg(F.count(F.lit(1)).alias("left"))
    if isinstance(least, int):
        return rows, count.filter(F.col("left") >= least).select("m")
    return rows, count.join(least, "m").filter(F.col("left") >= F.col("least")).select("m")


def _bounded(members: DataFrame, documents: DataFrame, id_col: str, text_col: str, percent: int, width: int, rows: int) -> DataFrame:
    """rep, s and c of the members (rep, s, c, n, groups) that may still link with a member of another component c, with f0 .. f15: how many of their
    shingles other components have too, by range of the hash. Everything is counted by hash, so a collision only loosens the bound."""
    members = cut(members.withColumn("m", F.xxhash64("rep", "s")))
    bits = 64 // rows
    each = [F.shiftrightunsigned("group", bits * k).bitwiseAND(F.lit((1 << bits) - 1)) if rows > 1 else F.col("group") for k in range(rows)]
    spread = members.select("m", "c", F.posexplode("groups").alias("at", "group"))
    total = spread.select("m", "c", "at", F.posexplode(F.array(*each)).alias("place", "value")).select("m", "c", F.xxhash64("at", "place", "value").alias("h"))
    least = needed(percent, rows * members.select(F.max(F.size("groups"))).first()[0]) if members.take(1) else 0
    for _ in range(MINHASH_PEELS):
        total, left = _peel(total, least)
        left = cut(left)
        total = total.join(left, "m", "left_semi")
    members = members.join(left, "m", "left_semi").drop("groups")
    need = members.groupBy("m").agg(F.min(F.ceil(F.col("n") * percent / 100)).alias("least"))

    wanted = _texts_of(members.select(F.col("rep").alias("id")), documents, id_col, text_col)
    sets = wanted.mapInArrow(_sets(width), "rep long, s long, sets array<long>").join(members, ["rep", "s"])
    shingles = sets.select("m", "c", F.explode("sets").alias("h"))
    for k in range(SHINGLE_PEELS):
        shingles, left = _peel(shingles, need)
        if k < SHINGLE_PEELS - 1:
            shingles = cut(shingles.join(left, "m", "left_semi"))
    parts = [F.count_if(F.shiftrightunsigned("h", 60) == k).alias(f"f{k}") for k in range(RANGES)]
    counts = shingles.join(left, "m", "left_semi").groupBy("m").agg(*parts)
    return cut(members.join(counts, "m").drop("m"))


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, width: int = 5, tables: int = 12, rows: int = 2) -> DataFrame:
    """One row per row of documents: the id, n_shingles, component_id (least id reachable by links), kept (it is the least).

    A document's set holds its distinct width-word shingles over whole texts, compared without the case of A-Z; two documents link if
    100 * intersection >= percent * union, found by comparing words. Null or blank texts have an empty set and link with nothing. Rows with one id
    are one document: a link of any of them counts. Rows with a null id link with nothing: component_id null, kept true. Other
    columns of documents, whatever their names, don't matter. An empty table gives an empty result.
    """
    if tables % 2:
        raise ValueError("tables must be even")
    base = cut(signatures(documents, id_col, text_col, width, tables, rows))
    sized = base.filter("s1 is not null and id is not null")
    classes = sized.groupBy("s1", "s2").agg(F.min("id").alias("rep"))
    member = sized.select("id", "s1", "s2").join(classes, ["s1", "s2"])
    copies = member.filter("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))

    heads = sized.join(classes, ["s1", "s2"]).filter("id = rep").dropDuplicates(["rep", "s1", "s2"]).withColumnRenamed("s1", "s").drop("id", "s2")
    heads = cut(heads)
    keyed = heads.select("rep", "s", F.posexplode("groups").alias("at", "group")).repartition("at", "group")
    shared = keyed.groupBy("at", "group").agg(F.min("s").alias("low"), F.max("s").alias("high")).filter("low < high").select("at", "group")
    live = keyed.join(shared, ["at", "group"], "left_semi")
    sides = live.groupBy("rep", "s").agg(*[F.collect_list(F.when(c, F.struct("at", "group"))).alias(x) for x, c in (("one", F.col("at") < tables), ("two", F.col("at") >= tables))])
    every = sides.select("rep", "s", F.explode("one").alias("k1"), "two").select("rep", "s", "k1", F.explode("two").alias("k2"))
    every = every.select(F.xxhash64("k1.at", "k1.group", "k2.at", "k2.group").alias("key"), (F.col("k1.at") * 256 + F.col("k2.at")).alias("at"), "rep", "s").repartition("key")
    multi = every.groupBy("key").agg(F.min("s").alias("low"), F.max("s").alias("high")).filter("low < high").select("key")
    tensor = cut(every.join(multi, "key", "left_semi"))

    limit = allowed(percent, min(NIBBLES, 2 * tables * rows))

    def differing(one: Column, two: Column) -> Column:
        x = one.bitwiseXOR(two)
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        return F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))

    def alike(i: str, j: str) -> Column:
        apart = sum((differing(F.col(f"{x}{i}"), F.col(f"{x}{j}")) for x in ("x1", "x2")), F.lit(0))
        return (F.least(f"n{i}", f"n{j}") * 100 >= F.greatest(f"n{i}", f"n{j}") * percent) & (apart <= limit)

    one, two = (heads.select(*[F.col(c).alias(f"{c}{i}") for c in ("rep", "n", "x1", "x2")]) for i in ("1", "2"))

    def check(pairs: DataFrame, tried: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """The pairs that pass the tests and haven't been tried, and of these the confirmed ones."""
        near = pairs.join(one, F.col("a") == F.col("rep1")).join(two, (F.col("b") == F.col("rep2")) & alike("1", "2")).select("a", "b").distinct()
        near = cut(near if tried is None else near.join(tried, ["a", "b"], "left_anti"))
        return near, cut(confirm(near, documents, id_col, text_col, percent, width))

    def centred(rows: DataFrame, orders: list[int]) -> DataFrame:
        """Pairs of each member with the least member of its buckets, one by each order. An order is by id xor a number, so the least gives the id back."""
        least = rows.groupBy("key").agg(*[F.min(F.col("rep").bitwiseXOR(F.lit(o))).alias(f"m{o}") for o in orders])
        best = rows.join(least, "key").groupBy("rep").agg(*[F.min(f"m{o}").bitwiseXOR(F.lit(o)).alias(f"m{o}") for o in orders])
        pairs = best.select("rep", F.explode(F.array_distinct(F.array(*[F.col(f"m{o}") for o in orders]))).alias("other")).filter("rep <> other")
        return pairs.select(F.least("rep", "other").alias("a"), F.greatest("rep", "other").alias("b")).distinct()

    def still_open(rows: DataFrame, found: DataFrame) -> DataFrame:
        """The rows of buckets that hold more than one component."""
        placed = rows.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("key", "at", "rep", "s", F.coalesce("component_id", "rep").alias("c"))
        mixed = placed.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low < high").select("key")
        return cut(placed.join(mixed, "key", "left_semi"))

    tried, linked = check(centred(tensor, [0]), None)
    found = components(copies.union(linked))
    open_ = still_open(tensor, found)
    pairs = centred(open_, [int(x) >> 2 for x in stream(33, CENTRES)])
    apart = [found.select(F.col("id").alias(x), F.col("component_id").alias(f"c_{x}")) for x in ("a", "b")]
    pairs = pairs.join(apart[0], "a", "left").join(apart[1], "b", "left").filter(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).select("a", "b")
    near, linked = check(pairs, tried)
    if linked.take(1):
        found = components(found.select(F.col("component_id").alias("a"), F.col("id").alias("b")).union(linked))
        open_ = still_open(open_.drop("c"), found)
    tried = tried.union(near)
    near_ones = _bounded(open_.select("rep", "s", "c").distinct().join(heads.select("rep", "s", "n", "groups"), ["rep", "s"]), documents, id_col, text_col, percent, width, rows)
    half = [F.xxhash64(F.col("groups")[k]) for k in range(2 * tables)]
    parts = [F.shiftrightunsigned(half[2 * k], 32).bitwiseXOR(half[2 * k + 1].bitwiseAND(F.lit(-1 << 32))).alias(f"g{k}") for k in range(tables)]
    marked = open_.drop("c").join(near_ones, ["rep", "s"]).join(heads.select("rep", "s", "x1", "x2", *parts), ["rep", "s"]).drop("s")
    # the groups before the two of the row's table, by the top bit of their halves: a pair that shares one of them meets in an earlier table
    one, two = F.shiftright("at", 8), F.col("at").bitwiseAND(F.lit(255))
    earlier = [F.lit(g) < (one if g < tables else two) for g in range(2 * tables)]
    masks = [F.when(earlier[2 * k], F.lit(1 << 31)).otherwise(F.lit(0)).bitwiseOR(F.when(earlier[2 * k + 1], F.lit(-(1 << 63))).otherwise(F.lit(0))).alias(f"e{k}") for k in range(tables)]
    # columns that can't be null keep the code of the join's condition small enough to be compiled
    plain = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in marked.columns if c != "at"]
    marked = marked.select(*plain, *masks)
    left, right = (marked.select("key", *[F.col(c).alias(f"{c}_{i}") for c in marked.columns if c != "key" and not (c[0] == "e" and i == "2")]) for i in ("1", "2"))

    def shared(k: int) -> Column:
        """Top bits of the halves that are zero in the difference of both sides' groups; above a zero half another one may be marked too."""
        x = F.col(f"g{k}_1").bitwiseXOR(F.col(f"g{k}_2"))
        return (x.bitwiseAND(F.lit((1 << 63) - 1)) - F.lit(0x0000000100000001)).bitwiseAND(F.bitwise_not(x)).bitwiseAND(F.col(f"e{k}_1"))

    sooner = shared(0)
    for k in range(1, tables):
        sooner = sooner.bitwiseOR(shared(k))
    both = sum((F.least(f"f{k}_1", f"f{k}_2") for k in range(RANGES)), F.lit(0))
    bound = both * (100 + percent) >= (F.col("n_1") + F.col("n_2")) * percent
    met = left.join(right, (left["key"] == right["key"]) & (F.col("c_1") < F.col("c_2")) & bound & alike("_1", "_2") & (sooner == 0))
    rest = met.select(F.least("rep_1", "rep_2").alias("a"), F.greatest("rep_1", "rep_2").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    rest = cut(rest)
    more = cut(confirm(rest, documents, id_col, text_col, percent, width))
    final = components(found.select(F.col("component_id").alias("a"), F.col("id").alias("b")).union(more)) if more.take(1) else found

    out = base.join(final, "id", "left").withColumn("component_id", F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("component_id") == F.col("id"), F.lit(True)).alias("kept"))
