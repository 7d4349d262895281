"""BPE encoding and decoding with a pair occurrence index.

A task takes the distinct pre-tokens of a stretch of its partition as one
line of byte symbols and maps every adjacent pair that has a rank to all its
positions. The active ranks are applied in ascending order: all occurrences
of the lowest pair are merged at once, the neighbours' pairs are looked up
and their positions added to the lists of their ranks, and entries that a
merge has made stale are dropped when their list is read. Pre-tokens are
independent, so this gives each the same merges as the library.

Memory: a stretch holds at most ``STRETCH`` characters (or one document), and
only its distinct pre-tokens are merged. Nothing is shuffled.

Defined results: a null text is encoded as the empty text (no ids, decoded to
the empty text); rows are independent, so repeats and null ids are kept; an
empty table gives an empty result; special strings inside a text become their
special ids, as the library does by default. Only doc_id and text are read.
"""

from __future__ import annotations

import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import map_arrow
from basketry.llm.pretokens import cutter, exact, library

#: Characters of text that are indexed together, unless one text is longer.
STRETCH = 8_000_000
#: Positions that are entered into the index together at first.
ENTER = 1 << 19
NO_RANK = np.iinfo(np.int64).max


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: the
    printable Latin-1 characters stand for themselves, the others, in order,
    for the code points from 256."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Merger:
    """The vocabulary as arrays: first symbols, pair ranks, token bytes."""

    def __init__(self, path: str):
        cut = cutter(path)
        letters = byte_letters()
        vocab = cut.vocab
        self.first = np.array([vocab[c] for c in letters], np.int32)
        left = np.array([vocab[a] for a, _ in cut.merges], np.int64)
        right = np.array([vocab[b] for _, b in cut.merges], np.int64)
        self.into = np.array([vocab[a + b] for a, b in cut.merges], np.int32)
        self.left, self.right = left, right
        pair = (left << 32) | right
        self.order = np.argsort(pair, kind="stable")
        self.pair = pair[self.order]
        of = {c: b for b, c in enumerate(letters)}
        size = max([*vocab.values(), *cut.special.values()]) + 1
        words = [b""] * size
        for token, i in vocab.items():
            words[i] = (bytes(of[c] for c in token) if all(c in of for c in token)
                        else token.encode())
        for token, i in cut.special.items():
            words[i] = token.encode()
        self.lengths = np.array([len(w) for w in words], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))
        self.bytes = np.frombuffer(b"".join(words), np.uint8)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a.astype(np.int64) << 32) | b
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where((a >= 0) & (b >= 0) & (self.pair[at] == key), self.order[at], NO_RANK)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): the ids of all words in one array, and where each ends."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        # the words in one line, a gap (-1) before each and one at the end
        n = len(raw) + len(words) + 1
        sym = np.full(n, -1, np.int32)
        body = np.arange(1, len(raw) + 1, dtype=np.int32)
        body += np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        sym[body] = self.first[raw]
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        after[-1] = n - 1
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def add(at: np.ndarray) -> None:
            rank = self.ranks(sym[at], sym[after[at]])
            known = rank != NO_RANK
            at, rank = at[known], rank[known]
            if not len(at):
                return
            by = np.argsort(rank, kind="stable")
            at, rank = at[by], rank[by]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            for r, places in zip(rank[np.concatenate(([0], cuts))].tolist(),
                                 np.split(at, cuts)):
                if r in index:
                    index[r].append(places)
                else:
                    index[r] = [places]
                    heapq.heappush(active, r)

        for lo in range(0, len(body), ENTER):
            add(body[lo:lo + ENTER])
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            a, b = self.left[r], self.right[r]
            at = lists[0] if len(lists) == 1 else np.concatenate(lists)
            at = np.unique(at[(sym[at] == a) & (sym[after[at]] == b)])
            if not len(at):
                continue
            if a == b and len(at) > 1:          # of overlapping pairs, every other from the left
                chained = np.concatenate(([False], after[at[:-1]] == at[1:]))
                i = np.arange(len(at))
                at = at[(i - np.maximum.accumulate(np.where(chained, 0, i))) % 2 == 0]
            gone = after[at]
            sym[at] = self.into[r]
            sym[gone] = -2
            after[at] = after[gone]
            before[after[at]] = at
            add(np.unique(np.concatenate((before[at], at))))
        kept = sym >= 0
        counts = np.cumsum(kept)
        ends = counts[np.cumsum(lengths) + np.arange(len(words))] if len(words) else np.zeros(
            0, np.int64)
        return sym[kept], ends

    def decode(self, ids: np.ndarray) -> bytes:
        lengths = self.lengths[ids]
        total = int(lengths.sum())
        shift = self.starts[ids] - np.concatenate(([0], np.cumsum(lengths)[:-1]))
        return self.bytes[np.arange(total) + np.repeat(shift, lengths)].tobytes()


@lru_cache(maxsize=2)
def merger(path: str) -> Merger:
    return Merger(path)


class _Slots(dict):
    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def _gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the stretches [start, start + length), one after another."""
    before = np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(lengths) else lengths
    return np.arange(int(lengths.sum())) + np.repeat(starts - before, lengths)


def encode_texts(texts: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts in one array, offsets: len(texts) + 1)."""
    cut, merge = cutter(path), merger(path)
    slots = _Slots()
    runs: list[np.ndarray] = []
    for t in texts:
        # a text that is not cut exactly is a run of slots with the library's own ids
        pieces = cut.pieces(t) if exact(t) else library(path).encode(
            t, add_special_tokens=False).ids
        runs.append(np.fromiter(map(slots.__getitem__, pieces), np.int32, len(pieces)))
    words = list(slots)
    fixed = np.array([isinstance(w, int) for w in words], bool)
    ids, ends = merge.merge([b"" if isinstance(w, int) else w.encode() for w in words])
    starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    lengths = ends - starts
    if fixed.any():                             # special ids after the merged ones
        extra = np.array([w for w in words if isinstance(w, int)], np.int32)
        starts[fixed] = len(ids) + np.arange(len(extra))
        lengths[fixed] = 1
        ids = np.concatenate((ids, extra))
    parts = [ids[_gather(starts[r], lengths[r])] for r in runs]
    offsets = np.cumsum([0] + [len(x) for x in parts])
    return (np.concatenate(parts) if parts else ids[:0]), offsets


def _stretches(batch: pa.RecordBatch, column: int):
    """(row range, texts) of at most STRETCH characters."""
    lo, texts, size = 0, [], 0
    for i, v in enumerate(batch.column(column)):
        t = v.as_py() or ""
        if texts and size + len(t) > STRETCH:
            yield lo, texts
            lo, texts, size = i, [], 0
        texts.append(t)
        size += len(t)
    if texts:
        yield lo, texts


def _decoded(ids: np.ndarray, offsets: np.ndarray, path: str) -> list[str]:
    m = merger(path)
    return [m.decode(ids[a:b]).decode("utf-8", "replace")
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def _run(path: str, with_text: bool):
    def run(batches):
        for b in batches:
            for lo, texts in _stretches(b, 1):
                ids, offsets = encode_texts(texts, path)
                arrays = [b.column(0).slice(lo, len(texts)),
                          pa.ListArray.from_arrays(pa.array(offsets, pa.int32()),
                                                   pa.array(ids, pa.int32()))]
                if with_text:
                    arrays.append(pa.array(_decoded(ids, offsets, path), pa.string()))
                yield pa.RecordBatch.from_arrays(
                    arrays, ["doc_id", "ids", "decoded"][:len(arrays)])
    return run


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int) for every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(
        docs.select("doc_id", F.col("text").cast("string")), _run(path, False),
        f"doc_id {kind}, ids array<int>")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, decoded: every text encoded, and its ids decoded again, in
    one pass."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(
        docs.select("doc_id", F.col("text").cast("string")), _run(path, True),
        f"doc_id {kind}, ids array<int>, decoded string")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, decoded for every row of (doc_id, ids); null ids decode to the
    empty text."""
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches):
        m = merger(path)
        for b in batches:
            out = [m.decode(np.asarray(v.as_py() or [], np.int64)).decode("utf-8", "replace")
                   for v in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())],
                                             ["doc_id", "decoded"])

    return map_arrow(encoded.select("doc_id", "ids"), run,
                     f"doc_id {kind}, decoded string")
