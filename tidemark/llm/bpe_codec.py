"""Byte-level BPE encoding and decoding through a global shuffle of distinct words.

A block is some MB of consecutive texts of a partition. Its pre-tokens become positions in the block's own list of words, told apart by
their bytes.

1. Each block deals its distinct words out by hash: one packed row for each bucket.
2. A bucket's task sees every block's words, encodes each distinct one once, and packs the ids back for each block.
3. Blocks meet their ids again; the ids of the texts are put together by position. Decoding looks the ids up in the token table.

Rows are packed, so what is shuffled is about as large as the compressed texts: the words of each block once, their ids, and a
position for each pre-token. Hot words reach a bucket once for each block that has them, never once for each occurrence. Rows of
(word, block, number) with joins by word and to a table of token bytes give the same, but write 4.9 times the input to disk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, shuffle_partitions
from .bpe import RankEncoder, pre_tokens, ranks_of
from .kernels import U64, chunks, distinct, splitmix

BLOCK = 2 << 20
_ENCODERS: dict[bytes, RankEncoder] = {}


def _encoder(content: bytes) -> RankEncoder:
    if content not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[content] = RankEncoder(ranks_of(content))
    return _ENCODERS[content]


def _pack(*arrays: np.ndarray | bytes) -> bytes:
    """Numbers as planes of bytes, so that high bytes compress away."""
    parts = []
    for a in arrays:
        raw = a if isinstance(a, bytes) else a.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
        small = pa.compress(raw, codec="zstd", asbytes=True) if raw else b""
        parts.append(len(raw).to_bytes(8, "little") + len(small).to_bytes(8, "little") + small)
    return b"".join(parts)


def _unpack(packed: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(packed):
        size, small = (int.from_bytes(packed[at + k : at + k + 8], "little") for k in (0, 8))
        out.append(pa.decompress(packed[at + 16 : at + 16 + small], decompressed_size=size, codec="zstd", asbytes=True) if size else b"")
        at += 16 + small
    return out


def _numbers(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


def _blocks(batches: Iterator[pa.RecordBatch], buckets: int):
    """(block, first row, end row, batch, bytes, offsets, starts, lens, words by first place, bucket of each word, positions, texts' counts).

    Words are ordered by bucket, then by hash, so that bucket by bucket they make up the block's word list.
    """
    block = TaskContext.get().partitionId() << 32
    for batch in batches:
        for i, j, data, offsets in chunks(batch.column(1), BLOCK):
            starts, lens, count = pre_tokens(data, offsets)
            first, keys, inverse = distinct(data, starts, lens)
            bucket = (splitmix(keys) % U64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            place = np.empty(len(keys), np.int64)
            place[order] = np.arange(len(keys))
            yield block, i, j, batch, data, starts, lens, first[order], bucket[order], place[inverse], count
            block += 1


def _deal(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, _, _, data, starts, lens, first, bucket, _, _ in _blocks(batches, buckets):
            raw = data.tobytes()
            size = lens[first]
            edges = np.searchsorted(bucket, np.arange(buckets + 1))
            rows = []
            for b in np.flatnonzero(np.diff(edges)):
                own = first[edges[b] : edges[b + 1]]
                words = b"".join([raw[s : s + n] for s, n in zip(starts[own].tolist(), lens[own].tolist(), strict=True)])
                rows.append((int(b), block, _pack(size[edges[b] : edges[b + 1]], words)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["bucket", "block", "words"])

    return run


def _encode(shipped):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shipped.value)
        bucket, known = None, {}
        for batch in batches:
            for b, block, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != bucket:
                    bucket, known = b, {}
                sizes, words = _unpack(packed)
                counts, ids, at = [], [], 0
                for n in _numbers(sizes).tolist():
                    word = words[at : at + n]
                    at += n
                    own = known.get(word)
                    if own is None:
                        own = known[word] = encoder.encode(word)
                    counts.append(len(own))
                    ids += own
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b], pa.int32()), pa.array([block], pa.int64()), pa.array([_pack(np.array(counts), np.array(ids, np.int64))], pa.binary())], names=["bucket", "block", "ids"]
                )

    return run


def _positions(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, i, j, batch, data, _, _, first, _, place, count in _blocks(batches, buckets):
            ids = batch.column(0).slice(i, j - i)
            check = int.from_bytes(hashlib.blake2b(data.tobytes(), digest_size=7).digest(), "little")
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.array([_pack(count, place)], pa.binary()), pa.array([len(first)], pa.int64()), pa.array([check], pa.int64())],
                names=["block", "doc_ids", "positions", "n_words", "digest"],
            )

    return run


def _reassemble(shipped, keep_ids: bool):
    def run(texts: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        tokens = _encoder(shipped.value).tokens
        parts = [_unpack(x) for x in words.sort_values("bucket")["ids"]]
        counts = np.concatenate([_numbers(p[0]) for p in parts]).astype(np.int64) if parts else np.empty(0, np.int64)
        ids = np.concatenate([_numbers(p[1]) for p in parts]) if parts else np.empty(0, np.uint32)
        begin = np.cumsum(counts) - counts
        row = texts.iloc[0]
        if len(texts) != 1 or len(counts) != row["n_words"]:
            raise RuntimeError("a block's words differ between two readings of the input; pass stable=False")
        per_text, place = map(_numbers, _unpack(row["positions"]))
        out, whole, at = [], hashlib.blake2b(digest_size=7), 0
        for doc, n in zip(row["doc_ids"], per_text.tolist(), strict=True):
            own = place[at : at + n]
            at += n
            size = counts[own]
            first = np.cumsum(size) - size
            flat = ids[np.arange(int(size.sum())) + np.repeat(begin[own] - first, size)]
            decoded = b"".join([tokens[k] for k in flat.tolist()])
            whole.update(decoded)
            doc = None if pd.isna(doc) else int(doc)
            out.append((doc, len(flat), hashlib.sha256(flat.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(decoded).hexdigest(), *((flat.astype(np.int64).tolist(), decoded.decode("utf-8")) if keep_ids else ())))
        if int.from_bytes(whole.digest(), "little") != row["digest"]:
            raise RuntimeError("decoded bytes differ from the texts of the first reading; pass stable=False")
        names = ["id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if keep_ids else [])]
        return pd.DataFrame(out, columns=names).astype({"id": "Int64"})

    return run


def encode_decode(documents: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False, stable: bool = True) -> DataFrame:
    """One row per row of documents: the id, n_tokens, ids_sha256 (little-endian unsigned 32-bit ids), decoded_sha256.

    ranks: the path, on the driver, of a rank file. Each match of the public pattern is encoded separately, without special
    tokens. keep_ids adds ids and decoded, the whole list and text. Null texts are empty and have no ids; the id may be null or
    repeated; other columns don't matter. An empty table gives an empty result. The input is read twice. Tables come alike both times; for
    another input, such as one behind a shuffle, stable=False writes its texts to the checkpoint folder first. That both
    readings agree is checked, and the job fails if they don't.
    """
    spark = documents.sparkSession
    buckets = shuffle_partitions(spark)
    shipped = spark.sparkContext.broadcast(Path(ranks).read_bytes())  # the size of one vocabulary file, whatever the data
    slim = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    slim = slim if stable else cut(slim)
    dealt = slim.mapInArrow(_deal(buckets), "bucket int, block long, words binary").repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket")
    back = dealt.mapInArrow(_encode(shipped), "bucket int, block long, ids binary")
    texts = slim.mapInArrow(_positions(buckets), "block long, doc_ids array<long>, positions binary, n_words long, digest long")
    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<long>, decoded string" if keep_ids else "")
    out = texts.groupBy("block").cogroup(back.groupBy("block")).applyInPandas(_reassemble(shipped, keep_ids), schema)
    return out.withColumnRenamed("id", id_col)
