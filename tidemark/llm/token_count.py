"""Token counts by heap-and-linked-list byte-pair merging.

The count of a pre-token is its bytes minus its merges; no ids are made. A task counts each distinct pre-token of a chunk of
texts once, told apart by its bytes, and keeps the counts of earlier ones in a table of bounded size. Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Merger, merger_of_json, pre_tokens
from .kernels import CHUNK, chunks, distinct, int64

KEPT = 192 << 20
_MODELS: dict[bytes, tuple[Merger, list[bytes], dict[bytes, int]]] = {}


def _model(content: bytes) -> tuple[Merger, list[bytes], dict[bytes, int]]:
    if content not in _MODELS:
        _MODELS.clear()
        _MODELS[content] = (*merger_of_json(content), {})
    return _MODELS[content]


def _counts(words: list[bytes], merger: Merger, known: dict[bytes, int]) -> list[int]:
    """The tokens of each word. known keeps them until its words and entries are about KEPT bytes, then starts anew."""
    counts = [known.get(w) for w in words]
    for k, c in enumerate(counts):
        if c is None:
            counts[k] = known[words[k]] = merger.count(words[k])
            known[b""] = known.get(b"", 0) + len(words[k]) + 150
    if known.get(b"", 0) > KEPT:
        known.clear()
    return counts


def _without_special(data: np.ndarray, offsets: np.ndarray, special: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts cut at special strings: bytes, offsets and text numbers of the parts, and how many special strings each text has."""
    found = np.zeros(len(offsets) - 1, np.int64)
    raw = data.tobytes()
    if not any(s in raw for s in special):
        return data, offsets, np.arange(len(found)), found
    parts, owners, ends = [], [], [0]
    for k in range(len(found)):
        pieces = [raw[offsets[k] : offsets[k + 1]]]
        for s in special:
            split = [p.split(s) for p in pieces]
            found[k] += sum(len(p) - 1 for p in split)
            pieces = [x for p in split for x in p]
        for p in pieces:
            parts.append(p)
            owners.append(k)
            ends.append(ends[-1] + len(p))
    return np.frombuffer(b"".join(parts), np.uint8), np.array(ends), np.array(owners), found


def count_chunk(data: np.ndarray, offsets: np.ndarray, model: tuple) -> np.ndarray:
    """The number of tokens of each text."""
    merger, special, known = model
    data, cuts, owner, total = _without_special(data, offsets, special)
    starts, lens, per_part = pre_tokens(data, cuts)
    if not len(starts):
        return total
    first, _, inverse = distinct(data, starts, lens)
    raw = data.tobytes()
    counts = np.array(_counts([raw[s : s + n] for s, n in zip(starts[first].tolist(), lens[first].tolist(), strict=True)], merger, known))
    texts = np.repeat(owner, per_part)
    return total + np.bincount(texts, weights=counts[inverse], minlength=len(total)).astype(np.int64)


def count_tokens(documents: DataFrame, tokenizer: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of documents: the id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    tokenizer: the path, on the driver, of a byte-level BPE file of the tokenizers library. Counts are those of the library
    without begin, end or added special tokens; special strings inside a text count one each, as is its default. Null
    texts are empty and have 0 tokens; the id may be null or repeated; other columns don't matter.
    """
    content = Path(tokenizer).read_bytes()
    shipped = documents.sparkSession.sparkContext.broadcast(content)  # the size of one vocabulary file, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shipped.value)
        for batch in batches:
            for i, j, data, offsets in chunks(batch.column(1), 4 * CHUNK):
                tokens = count_chunk(data, offsets, model)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), int64(np.diff(offsets)), int64(tokens), pa.array(tokens > limit)], names=["id", "n_bytes", "n_tokens", "over_limit"]
                )

    slim = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, "id long, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
