"""Byte-level byte-pair encoding: vectorised pre-tokens, merging with a heap over a linked list, and rank files.

Pre-tokens are those of the public pattern
    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
found for a whole chunk of texts at once from the class of each code point.
"""

from __future__ import annotations

import base64
import heapq
import json

import numpy as np
import regex

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: The code points of White_Space, and the contractions of the pattern.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]
_CLASSES: np.ndarray | None = None


def classes() -> np.ndarray:
    """The class of every code point."""
    global _CLASSES
    if _CLASSES is None:
        table = np.full(0x110000, OTHER, np.uint8)
        every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
            for m in regex.finditer(pattern, every):
                first, last = ord(m[0][0]), ord(m[0][-1])
                if last - first == len(m[0]) - 1:
                    table[first : last + 1] = kind
                else:
                    table[[ord(c) for c in m[0]]] = kind
        table[WHITE_SPACE] = SPACE
        _CLASSES = table
    return _CLASSES


def pre_tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and lengths of the pre-tokens of UTF-8 texts, which cover them, and the number of pre-tokens of each text."""
    n_texts = len(offsets) - 1
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(n_texts, np.int64)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    kind = classes()[points]
    n = len(points)
    opens = np.zeros(n + 1, bool)
    opens[np.searchsorted(lead, offsets)] = True
    change = opens[:-1].copy()
    change[0] = True
    change[1:] |= kind[1:] != kind[:-1]
    start = change.copy()

    white = kind == SPACE
    after = np.zeros(n, bool)  # the last white space of a run that other characters of the same text follow
    after[:-1] = white[:-1] & ~white[1:] & ~opens[1:-1]
    start |= after
    blank = after & (points == 0x20)  # joins the run behind it
    start[np.flatnonzero(blank) + 1] = False

    quote = np.flatnonzero(start & (points == 0x27))
    if len(quote):
        text_end = np.append(np.flatnonzero(opens[1:]) + 1, n)
        for word in CONTRACTIONS:
            q = quote[quote + len(word) < n]
            ok = np.ones(len(q), bool)
            for k, letter in enumerate(word, 1):
                ok &= points[q + k] == ord(letter)
            q = q[ok]
            q = q[q + len(word) < text_end[np.searchsorted(text_end, q, side="right")]]
            start[q + 1] = False
            rest = q + len(word) + 1
            start[rest[rest < n]] = True
    at = np.flatnonzero(start)
    begins = lead[at]
    owner = np.searchsorted(offsets, begins, side="right") - 1
    return begins, np.diff(np.append(begins, len(data))), np.bincount(owner, minlength=n_texts)


class Merger:
    """Merges of adjacent pairs by rank. pairs: left << 20 | right -> rank << 20 | merged, symbols being numbers below 2 ** 20."""

    def __init__(self, symbol: list[int], pairs: dict[int, int]):
        self.symbol, self.pairs = symbol, pairs

    def links(self, word: bytes) -> tuple[list[int], int]:
        """Symbols by first byte (-1 where merged away) and the number of merges.

        The heap gives the lowest rank, the leftmost first; an entry whose place holds another pair by now is void.
        """
        symbols = [self.symbol[b] for b in word]
        size = len(symbols)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        pairs, heap, merges = self.pairs, [], 0
        for k in range(size - 1):
            found = pairs.get(symbols[k] << 20 | symbols[k + 1])
            if found is not None:
                heap.append((found >> 20) << 40 | k)
        heapq.heapify(heap)
        while heap:
            entry = heapq.heappop(heap)
            k = entry & 0xFFFFFFFFFF
            j = after[k]
            if symbols[k] < 0 or j >= size:
                continue
            found = pairs.get(symbols[k] << 20 | symbols[j])
            if found is None or found >> 20 != entry >> 40:
                continue
            merged = found & 0xFFFFF
            symbols[k], symbols[j] = merged, -1
            merges += 1
            after[k] = nxt = after[j]
            if nxt < size:
                before[nxt] = k
                found = pairs.get(merged << 20 | symbols[nxt])
                if found is not None:
                    heapq.heappush(heap, (found >> 20) << 40 | k)
            prev = before[k]
            if prev >= 0:
                found = pairs.get(symbols[prev] << 20 | merged)
                if found is not None:
                    heapq.heappush(heap, (found >> 20) << 40 | prev)
        return symbols, merges

    def count(self, word: bytes) -> int:
        """Initial symbols minus merges; no ids are made."""
        return len(word) - self.links(word)[1]

    def encode(self, word: bytes) -> list[int]:
        return [s for s in self.links(word)[0] if s >= 0]


def byte_letters() -> dict[str, int]:
    """The public mapping of bytes to printable letters, inverted: printable bytes stand for themselves, others follow from 256."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def merger_of_json(content: bytes) -> tuple[Merger, list[bytes]]:
    """A merger by the order of merges of a tokenizers file, and the added strings that are found inside texts."""
    spec = json.loads(content)
    letters = byte_letters()
    number: dict[str, int] = {letter: b for letter, b in letters.items()}
    pairs = {}
    for rank, merge in enumerate(spec["model"]["merges"]):
        left, right = merge if isinstance(merge, list) else merge.split(" ")
        merged = number.setdefault(left + right, len(number))
        pairs[number[left] << 20 | number[right]] = rank << 20 | merged
    return Merger(list(range(256)), pairs), [t["content"].encode() for t in spec["added_tokens"]]


def ranks_of(content: bytes) -> list[bytes]:
    """The byte string of each id of a rank file."""
    ranks = {int(b): base64.b64decode(a) for a, b in map(bytes.split, content.splitlines()) if a}
    return [ranks.get(k, b"") for k in range(max(ranks) + 1)]


class RankEncoder:
    """Ids of a pre-token by a rank file: the whole if it has a rank, else pairs merged while one has, the lowest rank first."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.rank = rank = {t: k for k, t in enumerate(tokens) if t}
        pairs = {}
        for t, k in rank.items():
            for cut in range(1, len(t)):
                left, right = rank.get(t[:cut]), rank.get(t[cut:])
                if left is not None and right is not None:
                    pairs[left << 20 | right] = k << 20 | k
        self.merger = Merger([rank[bytes([b])] for b in range(256)], pairs)

    def encode(self, word: bytes) -> list[int]:
        whole = self.rank.get(word)
        return [whole] if whole is not None else self.merger.encode(word)
