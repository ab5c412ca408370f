"""Document fingerprints: a Merkle tree over sections, paragraphs and phrases.

A paragraph is what lies between newlines; a section is a run of paragraphs that ends after an empty one, or where the last
paragraph's digest says so, so that an insertion moves only the section it is in. The root is the digest of the sections'
digests, theirs of the paragraphs': texts are equal if their roots are. Under a paragraph, phrases of about four words, ended
where a word's hash says so, are the leaves. A fingerprint holds the tree down to the paragraphs, with digests cut short below the
root, and a bottom-k sketch of all nodes' hashes, the leaves included. So fingerprints alone tell equality (roots), the paragraphs in which two
texts differ (branches), and their likeness, the Jaccard similarity of the trees' nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shuffle_partitions
from .kernels import CHUNK, U64, chunks, runs, segment_hash, splitmix, words

SKETCH = 64
FIRST_ID = -(1 << 63)


def _phrases(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of phrases and of paragraphs, and the text each belongs to."""
    p_starts, p_lens = runs(data != 0x0A, offsets)
    paragraph = splitmix(segment_hash(data, p_starts, p_lens))
    p_owner = np.searchsorted(offsets, p_starts, side="right") - 1
    starts, lens, owner = words(data, offsets)
    if not len(starts):
        return paragraph, p_owner
    hashed = segment_hash(data, starts, lens)
    line = np.cumsum(data == 0x0A)[starts]
    new = np.ones(len(starts), bool)
    new[1:] = ((hashed[:-1] & U64(3)) == 0) | (line[1:] != line[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    place = np.arange(len(starts)) - np.repeat(at, np.diff(np.append(at, len(starts))))
    phrase = splitmix(np.add.reduceat(hashed * (U64(2) * place.astype(U64) + U64(1)), at))
    return np.concatenate([phrase, paragraph]), np.concatenate([owner[at], p_owner])


def _sections(text: bytes) -> tuple[bytes, list[tuple[bytes, list[bytes]]]]:
    """The root and, for each section, its digest and its paragraphs' digests."""
    found, held = [], []
    for paragraph in text.split(b"\n"):
        held.append(digest := hashlib.sha256(paragraph).digest())
        if not paragraph or not digest[0] & 3:
            found.append((hashlib.sha256(b"section" + b"".join(held)).digest(), held))
            held = []
    if held:
        found.append((hashlib.sha256(b"section" + b"".join(held)).digest(), held))
    return hashlib.sha256(b"root" + b"".join(s for s, _ in found)).digest(), found


def fingerprints(texts: list[str]) -> list[str]:
    """root:nodes:sketch:branches of each text, in hexadecimal. nodes is the number of distinct node hashes; branches has, for each section, its
    digest, cut to 64 bits, and those of its paragraphs, cut to 32."""
    out = []
    for i, j, data, offsets in chunks(pa.array(texts, pa.string())):
        value, owner = _phrases(data, offsets)
        raw = data.tobytes()
        value = (value >> U64(32)).astype(np.uint32)
        value = value[order := np.lexsort((value, owner))]
        edges = np.searchsorted(owner[order], np.arange(j - i + 1))
        for k in range(j - i):
            root, sections = _sections(raw[offsets[k] : offsets[k + 1]])
            own = np.concatenate([value[edges[k] : edges[k + 1]], np.array([int.from_bytes(s[:4], "big") for s, _ in sections], np.uint32)])
            own = np.unique(own)
            branches = ";".join(s.hex()[:16] + "=" + b"".join([p[:4] for p in held]).hex() for s, held in sections)
            out.append(f"{root.hex()}:{len(own)}:{own[:SKETCH].astype('>u4').tobytes().hex()}:{branches}")
    return out


def likeness(a: str, b: str) -> float:
    """Jaccard similarity of the trees' nodes, from 0 to 1: exact up to SKETCH nodes, estimated by the least SKETCH of the union above; 1 for equal roots."""
    root_a, n_a, sketch_a, _ = a.split(":")
    root_b, n_b, sketch_b, _ = b.split(":")
    if root_a == root_b:
        return 1.0
    one, two = (np.frombuffer(bytes.fromhex(s), ">u4") for s in (sketch_a, sketch_b))
    union = np.union1d(one, two)
    if int(n_a) > SKETCH or int(n_b) > SKETCH:
        union = union[:SKETCH]
    both = np.intersect1d(one, two, assume_unique=True)
    return float(np.isin(union, both, assume_unique=True).sum() / len(union)) if len(union) else 0.0


def differing(a: str, b: str) -> tuple[list[int], list[int]]:
    """From two fingerprints, the numbers of the paragraphs of either text whose branch isn't in the other's tree. Equal sections aren't descended into."""
    (root_a, *_, one), (root_b, *_, two) = a.split(":"), b.split(":")
    if root_a == root_b:
        return [], []
    trees = [[(s[:16], [s[k : k + 8] for k in range(17, len(s), 8)]) for s in x.split(";")] for x in (one, two)]
    out = []
    for own, other in (trees, trees[::-1]):
        sections = {s for s, _ in other}
        leaves = {p for _, ps in other for p in ps}
        found, at = [], 0
        for s, ps in own:
            if s not in sections:
                found += [at + k for k, p in enumerate(ps) if p not in leaves]
            at += len(ps)
        out.append(found)
    return out[0], out[1]


def fingerprint(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fingerprint of each row's whole text (null: empty). Nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = fingerprints([x or "" for x in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.string())], names=["id", "fingerprint"])

    slim = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, "id long, fingerprint string").withColumnRenamed("id", id_col)


def _edit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by id, after them what follows the partition. Each row meets the next."""
    held: list[tuple] = []
    size, over = 0, False

    def flush() -> pa.RecordBatch:
        ids, texts = [r[0] for r in held], [r[1] for r in held]
        edited = []
        for k in range(len(held) - 1):
            cut = len(texts[k]) // 4
            edited.append(texts[k][: len(texts[k]) - cut] + texts[k + 1][:cut])
        own, new = fingerprints(texts), fingerprints(edited)
        columns = [
            pa.array([None if x == FIRST_ID else x for x in ids[:-1]], pa.int64()),
            pa.array([len(t) for t in texts[:-1]], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
            pa.array(own[:-1], pa.string()),
            pa.array(new, pa.string()),
            pa.array([likeness(a, b) for a, b in zip(own, new)], pa.float64()),
            pa.array([likeness(a, b) for a, b in zip(own, own[1:])], pa.float64()),
            pa.array([min((x for x in differing(a, b)[0]), default=None) for a, b in zip(own, new)], pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "first_differing"])

    for batch in batches:
        for doc, text, tail in zip(*(batch.column(k) for k in range(3)), strict=True):
            if over:
                continue
            held.append((doc.as_py(), text.as_py() or ""))
            size += len(held[-1][1])
            over = tail.as_py()
            if (size >= CHUNK or len(held) > 2000) and len(held) > 1:
                yield flush()
                held, size = held[-1:], 0
    if len(held) > 1:
        yield flush()


def edit_report(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of an edited text, whose last quarter (floor) is replaced by the next document's start.

    One row per row of documents: the id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    first_differing (the first paragraph whose branch the edited text's tree hasn't, null if it has all). Next is by ascending id, null ids first, equal ids by text; after the last comes the first. Null texts are empty; a single
    document follows itself; other columns don't matter; an empty table gives an empty result. Texts move once, to ranges of ids;
    the first row of a range also goes to the range before it.
    """
    spark: SparkSession = documents.sparkSession
    slim = documents.select(F.coalesce(F.col(id_col).cast("long"), F.lit(FIRST_ID)).alias("id"), F.col(text_col).alias("text"))
    parts = shuffle_partitions(spark)
    cuts = sorted({int(x) for x in slim.approxQuantile("id", [k / parts for k in range(1, parts)], 0.2 / parts)}) if parts > 1 else []
    edges = np.array(cuts, np.int64)

    @F.pandas_udf("int")
    def part(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, ids.to_numpy(), side="right").astype(np.int32))

    least = slim.select("id").withColumn("p", part("id")).groupBy("p").agg(F.min("id").alias("low")).orderBy("p").collect()  # a row for each range
    heads = np.array([r["low"] for r in least], np.int64)
    n = len(heads)
    if not n:
        schema = f"`{id_col}` long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, first_differing long"
        return spark.createDataFrame([], schema)

    @F.pandas_udf("array<int>")
    def places(ids: pd.Series) -> pd.Series:
        own = np.searchsorted(heads, ids.to_numpy(), side="right") - 1
        first = heads[own] == ids.to_numpy()
        return pd.Series([[p, n + (p - 1) % n] if f else [p] for p, f in zip(own.tolist(), first.tolist(), strict=True)])

    dealt = slim.withColumn("at", F.explode(places("id"))).select("id", "text", (F.col("at") >= n).alias("tail"), (F.col("at") % n).alias("p"))
    ordered = dealt.repartitionById(n, F.col("p")).sortWithinPartitions("tail", "id", F.coalesce("text", F.lit("")))
    schema = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, first_differing long"
    return ordered.select("id", "text", "tail").mapInArrow(_edit_rows, schema).withColumnRenamed("id", id_col)
