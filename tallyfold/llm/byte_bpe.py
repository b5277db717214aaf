"""Byte-level BPE encoding and decoding by merge replay over the distinct words of a corpus.

The words lie one after the other in one array. An inverted index leads from the rank of a token pair to the positions where
that pair stands; it is worked off in order of rank, and each merge puts only the pairs with its two neighbours into the index
anew. Ranks are taken in ranges of WIDTH, since single ranks are often rare: within a range each word applies its lowest rank
at all its positions at once, and goes on with what is left. As words don't touch each other, each one sees its merges in order of rank.

The corpus of a replay is what a task reads, in slices of bounded size, without the words that its worker remembers.
"""

from __future__ import annotations

import base64
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tallyfold.llm.textbytes import lean, pieces

WIDTH = 1 << 7  # ranks of one range of the index
SLICE = 1 << 22  # bytes of text whose words are replayed together; a longer text is a slice of its own
CACHE = 1 << 25  # bytes that a worker remembers, of chunks that it met twice and their ids
SHORT = 64  # characters of the longest chunk that it remembers

#: Fixed value: the pattern of the rank files in use. In it a blank between two other characters always begins a match.
BLANK_FIRST = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Vocabulary:
    """Ranks of a tiktoken file: rank, which is the id, by bytes."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.load({base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())})

    def load(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.gap = max(self.tokens) + 1  # stands at both ends of words, and for "no token"
        if self.gap >= 1 << 31:
            raise ValueError("ids of 31 bits at the most")
        self._known: dict[str, bytes] = {}
        self._room = CACHE
        pairs = [(self.ranks[t[:i]] * (self.gap + 1) + self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        left = np.array(pairs, np.int64).reshape(-1, 2)
        self._bits = max(10, (8 * len(left)).bit_length())
        self._keys, self._values = np.full(1 << self._bits, -1, np.int64), np.full(1 << self._bits, self.gap, np.int64)
        slot = self._slot(left[:, 0])
        while len(left):
            free = self._keys[slot] == -1
            self._keys[slot[free]] = left[free, 0]  # of several for one slot the last stays
            own = self._keys[slot] == left[:, 0]
            self._values[slot[own]] = left[own, 1]
            left, slot = left[~own], slot[~own] + 1 & len(self._keys) - 1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self._bits)).astype(np.int64)

    def merges(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the tokens that pairs make, the gap where they make none."""
        key = a * (self.gap + 1) + b
        slot = self._slot(key)
        there = self._keys[slot]
        out = np.where(there == key, self._values[slot], self.gap)
        left = np.flatnonzero((there != key) & (there != -1))
        slot = slot[left] + 1 & len(self._keys) - 1
        while len(left):
            there = self._keys[slot]
            hit = there == key[left]
            out[left[hit]] = self._values[slot[hit]]
            on = ~hit & (there != -1)
            left, slot = left[on], slot[on] + 1 & len(self._keys) - 1
        return out

    def replay(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, packed. A token lies at the position of its first byte."""
        gap, n = self.gap, sum(map(len, words))
        sizes = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(sizes)
        symbol = np.append(self.single[np.frombuffer(b"".join(words), np.uint8)], gap)
        word = np.repeat(np.arange(len(words)), sizes)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        filled = sizes > 0
        after[ends[filled] - 1], before[(ends - sizes)[filled]] = n, n  # position n is the gap around all words
        rank = np.append(self.merges(symbol[:-1], symbol[after[:-1]]), gap)
        alive = np.ones(n, bool)
        index: dict[int, list[np.ndarray]] = {}

        def put(places: np.ndarray, least: int) -> None:
            """Into the range of their rank, in the current one at the earliest."""
            if not len(places):
                return
            at = np.maximum(rank[places] // WIDTH, least)
            order = np.argsort(at, kind="stable")
            at = at[order]
            first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            for r, some in zip(at[first].tolist(), np.split(places[order], first[1:]), strict=True):
                index.setdefault(r, []).append(some)

        put(np.flatnonzero(rank < gap), 0)
        while index:
            r = min(index)
            # What the index holds may be merged meanwhile, or stand there twice.
            p = np.concatenate(index.pop(r))
            p = np.sort(p[rank[p] < min(gap, (r + 1) * WIDTH)])
            p = p[np.append(True, p[1:] != p[:-1])[: len(p)]]
            if not len(p):
                continue
            new = np.append(True, word[p[1:]] != word[p[:-1]])
            low = np.minimum.reduceat(rank[p], np.flatnonzero(new))[np.cumsum(new) - 1]
            wait, p = p[rank[p] != low], p[rank[p] == low]
            # Of pairs that overlap each second one stays, from the left.
            first = np.append(True, after[p[:-1]] != p[1:])
            count = np.arange(len(p))
            kept = (count - np.maximum.accumulate(np.where(first, count, 0))) % 2 == 0
            wait, p = np.append(wait, p[~kept]), p[kept]
            token, second, left = rank[p], after[p], before[p]
            right = after[second]
            beside = np.append(False, right[:-1] == p[1:])  # the neighbour on the left is merged as well
            to_left = self.merges(np.where(beside, token, symbol[left]), token)
            to_right = self.merges(token, symbol[right])
            # A merge that opens one of lower rank yields to it before its word goes on to the right.
            opens = (to_left < token) | (to_right < token)
            if opens.any():
                seen = np.cumsum(opens) - opens
                new = np.append(True, word[p[1:]] != word[p[:-1]])
                go = seen == seen[np.flatnonzero(new)][np.cumsum(new) - 1]
                wait = np.append(wait, p[~go])
                p, token, second, left, right, beside, to_left, to_right = (x[go] for x in (p, token, second, left, right, beside, to_left, to_right))
            symbol[p], after[p], before[right] = token, right, p
            alive[second], rank[second] = False, gap
            rank[left[~beside]] = to_left[~beside]
            rank[p] = np.where(np.append(beside[1:], False), np.append(to_left[1:], gap), to_right)
            rank[n] = gap
            touched = np.concatenate([p, left[~beside], wait])
            put(touched[rank[touched] < gap], r)
        ids = symbol[:-1][alive].astype("<u4").tobytes()
        upto = [0, *(4 * np.append(0, np.cumsum(alive))[ends]).tolist()]
        return [ids[a:b] for a, b in zip(upto[:-1], upto[1:], strict=True)]

    def encode(self, texts: Iterable[list[str]], split: Callable[[str], list[str]] = lambda x: [x]) -> Iterator[bytes]:
        """Ids of each text, given as chunks that split takes apart into words, as little-endian unsigned 32-bit integers."""
        texts = list(texts)
        if self._room < 0:
            self._known.clear()
            self._room = CACHE
        found, seen = self._known, Counter(chain.from_iterable(texts))
        fresh, flat, counts, once = list(seen.keys() - found.keys()), [], [], {}
        for c in fresh:
            own = split(c)
            flat += own
            counts.append(len(own))
        raw = [w.encode() for w in flat]
        # As the libraries do, a word that is a token as a whole is that token.
        ids = {w: self.ranks[w].to_bytes(4, "little") for w in set(raw) & self.ranks.keys()}
        words = list(set(raw).difference(ids))
        ids.update(zip(words, self.replay(words), strict=True))
        each = map(ids.__getitem__, raw)
        for c, n in zip(fresh, counts, strict=True):
            x = next(each) if n == 1 else b"".join(islice(each, n))
            if seen[c] > 1 and len(c) <= SHORT:
                found[c] = x
                self._room -= 200 + 4 * len(c) + len(x)  # what the two objects take, roughly
            else:
                once[c] = x
        once.update((c, found[c]) for c in seen.keys() & found.keys())
        for chunks in texts:
            yield b"".join(map(once.__getitem__, chunks))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def splitters(pattern: str) -> tuple[Callable[[str], list[str]], Callable[[str], list[str]]]:
    """Text to chunks, and chunk to words. Where the pattern allows, chunks end before blanks, so that few are split by the pattern."""
    words = regex.compile(pattern).findall
    if pattern != BLANK_FIRST:
        return words, lambda x: [x]
    plain = re.compile(" ?[A-Za-z]+").fullmatch  # one match of the pattern for certain
    return re.compile(r"(?<=\S)(?= \S)").split, lambda c: [c] if plain(c) else words(c)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """A worker reads a file once."""
    return Vocabulary(path)


def bpe_encode(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",), decode: bool = False) -> DataFrame:
    """The `keep` columns of each row of docs (text string) and its ids as binary, little-endian unsigned 32-bit integers;
    with decode also `decoded`, what bpe_decode makes of the ids, in the same pass of the same worker.

    Each match of pattern is encoded separately, without special tokens, by the ranks in the file at path, which every
    worker must be able to open. Null and empty texts have no ids; a very long text is worked on as one; repeated rows come
    back repeated; an empty table gives an empty one; other columns are left out.
    """
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", ids binary" + ", decoded binary" * decode

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, (chunks, words) = vocabulary(path), splitters(pattern)
        for whole in batches:
            for batch in pieces(whole, "text", SLICE):
                texts = [chunks(x) if x else [] for x in batch.column("text").to_pylist()]
                ids = list(own.encode(texts, words))
                more = [pa.array(map(own.decode, ids), pa.binary())] if decode else []
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(ids, pa.binary()), *more], names=[*keep, "ids", *["decoded"] * decode])

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(lean(run), schema)


def bpe_decode(encoded: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The `keep` columns and ids of each row, and its bytes as `decoded`: what bpe_encode had as text, in UTF-8. Null ids stay null."""
    schema = ", ".join(f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in keep) + ", ids binary, decoded binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path)
        for whole in batches:
            for batch in pieces(whole, "ids"):
                ids = batch.column("ids")
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), ids, pa.array((None if x is None else own.decode(x) for x in ids.to_pylist()), pa.binary())], names=[*keep, "ids", "decoded"])

    return encoded.select(*dict.fromkeys([*keep, "ids"])).mapInArrow(lean(run), schema)
