"""Substring dedup by relative Lempel-Ziv parsing.

The reference of a document is every document with a smaller doc_id, in blocks. Its index holds the phrases of `window` words, each with its source: the smallest
doc_id that has it and the place there. A document is parsed greedily from left to right: a factor opens at the first word whose phrase the index holds
and runs on while the next phrase is held at the next place of the same source; where the source stops matching, the factor ends, and the next one opens with the
source of the phrase there. A factor is at least `window` words long. Words under a factor are a duplicate span.

How it runs. Documents are dealt into chunks by a hash of doc_id and text, once; the three passes below read that one exchange.
Phrases travel as sorted hash blocks, a binary value for each (chunk, index part), never a row for each phrase; an index part is as large as PART_CHUNKS
chunks, and a chunk sends no more rows than it has phrases.
1. Anchors. Of the `anchor`-word hashes in a phrase, the smallest is its anchor; equal phrases have equal anchors. Each
   chunk sends its distinct anchors; the index part answers, as a bitmap, which of them another chunk has too.
2. Phrases whose anchor occurs in more than one document (only they can repeat) go to the index with the smallest doc_id of the
   chunk, the place there and a second hash; the part answers with the source of those that another chunk has under a smaller doc_id.
3. The chunk parses its documents by those answers.
A chunk sends each distinct hash once, however many of its rows have it, so a phrase that a third of all documents share costs a
part one entry a chunk. A phrase equals its source if both of two independent 64-bit hashes agree, so at 1e13 phrases a wrong removal has a chance of about 1e-13;
phrases that clash in the first hash alone are not removed.

Defined cases: null or empty text has no words; fewer words than the window: nothing is removed; equal doc_ids (a
repeated row) are one document id, so neither is smaller than the other; a null doc_id is larger than every other; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from . import words as W
from .common import blocks_of, text_bytes

WINDOW = 13
ANCHOR = 6
CHUNK_BYTES = 8 << 20
PART_CHUNKS = 4
#: Stands for a null id: larger than every other.
NO_ID = (1 << 63) - 1
_REQUEST = "part int, chunk int, hashes binary, ids binary, places binary, checks binary"
_REPLY = "chunk int, part int, step int, bits binary, ids binary, places binary"
_SPAN = "array<struct<start:int,end:int>>"
_FACTOR = "array<struct<start:int,end:int,source:long,source_start:int>>"
_RESULT = f"doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string, spans {_SPAN}, factors {_FACTOR}"
_U = np.uint64


class Phrases:
    """Distinct phrases (or anchors) of a chunk, sorted by hash: the smallest id that has each, its place there, a second hash, and whether several ids have it."""

    def __init__(self, hashes: np.ndarray, ids: np.ndarray, places: np.ndarray | None = None, checks: np.ndarray | None = None):
        order = np.argsort(hashes, kind="stable")  # rows come by id and place, so the first of equal hashes is the smallest
        first = np.flatnonzero(np.append(True, hashes[order][1:] != hashes[order][:-1])[: len(order)])
        lead = order[first]
        self.hashes, self.ids = hashes[lead], ids[lead]
        self.several = np.maximum.reduceat(ids[order], first) != self.ids if len(first) else np.zeros(0, bool)
        self.places = None if places is None else places[lead]
        self.checks = None if checks is None else checks[lead]


class _Chunk:
    """The words, anchors and phrases of the documents of one chunk, in doc_id order."""

    def __init__(self, table: pa.Table, window: int, anchor: int):
        self.table = table.sort_by("doc_id")
        self.ids = self.table["doc_id"].combine_chunks().fill_null(NO_ID).to_numpy()
        self.window, self.parts = window, []
        for base, w in W.chunks(self.table["text"].combine_chunks()):
            phrase, at = w.grams(window)
            small, small_at = w.grams(anchor)
            best = np.zeros(0, _U)
            if len(at):
                # The anchors of the phrase at word i are those at words i to i + window - anchor.
                lead = np.full(len(w.hash), ~_U(0))
                lead[small_at] = small
                best = lead[at]
                for k in range(1, window - anchor + 1):
                    np.minimum(best, lead[at + k], out=best)
            doc = w.doc_of_word()[at]
            self.parts.append((base, w, phrase, at, best, self.ids[base + doc], at - w.offset[doc]))

    def _all(self, k: int, kind, keep: list[np.ndarray] | None = None) -> np.ndarray:
        return np.concatenate([np.zeros(0, kind), *(p[k] if keep is None else p[k][x] for p, x in zip(self.parts, keep or self.parts))])

    def anchors(self) -> Phrases:
        return Phrases(self._all(4, _U), self._all(5, np.int64))

    def phrases(self, repeated: np.ndarray) -> Phrases:
        """Distinct phrases whose anchor is among `repeated` (sorted)."""
        keep = [_in_sorted(p[4], repeated) for p in self.parts]
        checks = [self.checks(p[1])[x] for p, x in zip(self.parts, keep)]
        return Phrases(self._all(2, _U, keep), self._all(5, np.int64, keep), self._all(6, np.int64, keep).astype(np.int32), np.concatenate([np.zeros(0, _U), *checks]))

    def checks(self, w: W.Words) -> np.ndarray:
        """The second hashes of all phrases of a part."""
        return w.grams(self.window, w.other())[0]


def _in_sorted(value: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(value), bool)
    at = np.searchsorted(among, value)
    at[at == len(among)] = 0
    return among[at] == value


def _requests(chunk: int, found: Phrases, parts: int) -> pa.Table:
    """A row for each index part; hashes stay sorted within it. Anchors go without ids, places and second hashes."""
    part = (found.hashes >> _U(33)) % _U(parts)
    order = np.argsort(part, kind="stable")
    bounds = np.searchsorted(part[order], np.arange(parts + 1, dtype=_U))
    rows = [(p, order[a:b]) for p, (a, b) in enumerate(zip(bounds, bounds[1:])) if b > a]
    blob = lambda x: pa.array([b"" if found.places is None else x[at].tobytes() for _, at in rows], pa.binary())
    return pa.table({"part": pa.array([p for p, _ in rows], pa.int32()), "chunk": pa.array([chunk] * len(rows), pa.int32()), "hashes": pa.array([found.hashes[at].tobytes() for _, at in rows], pa.binary()), "ids": blob(found.ids), "places": blob(found.places), "checks": blob(found.checks)})


def _answers(replies: pa.Table, step: int, found: Phrases, parts: int) -> np.ndarray:
    """The bits of the replies of a step, in the order of the sorted hashes that were asked for. Sources that step 2 names take the place of the chunk's own."""
    part = (found.hashes >> _U(33)) % _U(parts)
    bits = np.zeros(len(found.hashes), bool)
    for row in replies.select(["part", "step", "bits", "ids", "places"]).to_pylist():
        if row["step"] == step:
            at = np.flatnonzero(part == _U(row["part"]))
            bits[at] = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=len(at)).view(bool)
            if step == 2:
                hit = at[bits[at]]
                found.ids[hit], found.places[hit] = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["places"], np.int32)
    return bits


def _index(step: int):
    """An index part: answers each chunk which of its hashes another chunk has (step 1), or has under a smaller id, and where (step 2)."""

    def run(table: pa.Table) -> pa.Table:
        column = lambda name, kind: np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in table[name]])
        hashes = column("hashes", _U)
        cut = np.cumsum([0, *(len(x.as_buffer()) // 8 for x in table["hashes"])])
        ids, places = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int32)
        if step == 1:
            order = np.argsort(hashes, kind="stable")
            first = np.flatnonzero(np.append(True, hashes[order][1:] != hashes[order][:-1]))
            count = np.diff(np.append(first, len(order)))
            bits = np.empty(len(hashes), bool)
            bits[order] = np.repeat(count > 1, count)
        else:
            own, place, check = column("ids", np.int64), column("places", np.int32), column("checks", _U)
            order = np.lexsort((place, own, hashes))
            first = np.flatnonzero(np.append(True, hashes[order][1:] != hashes[order][:-1]))
            source = np.empty(len(hashes), np.int64)
            source[order] = np.repeat(order[first], np.diff(np.append(first, len(order))))
            ids, places = own[source], place[source]
            bits = (ids < own) & (check[source] == check)
        spans = list(zip(cut, cut[1:]))
        held = lambda x: pa.array([b"" if step == 1 else x[a:b][bits[a:b]].tobytes() for a, b in spans], pa.binary())
        return pa.table({"chunk": table["chunk"], "part": table["part"], "step": pa.array([step] * len(table), pa.int32()), "bits": pa.array([np.packbits(bits[a:b]).tobytes() for a, b in spans], pa.binary()), "ids": held(ids), "places": held(places)})

    return run


def factors(at: np.ndarray, source: np.ndarray, place: np.ndarray, window: int) -> list[tuple[int, int, int, int]]:
    """Greedy parse of a document: (start, end, source, place in it) of every factor; at: the words whose phrases are held, with their sources."""
    if not len(at):
        return []
    on = (np.diff(at) == 1) & (np.diff(source) == 0) & (np.diff(place) == 1)
    first = np.flatnonzero(np.append(True, ~on))
    last = np.append(first[1:], len(at)) - 1
    return list(zip(at[first].tolist(), (at[last] + window).tolist(), source[first].tolist(), place[first].tolist()))


def covered(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int]]:
    """The duplicate spans that factors, in the order of their starts, cover together."""
    spans: list[tuple[int, int]] = []
    for a, b, *_ in found:
        if spans and a <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(b, spans[-1][1]))
        else:
            spans.append((a, b))
    return spans


def substring_dedup(docs: DataFrame, window: int = WINDOW, chunk_bytes: int = CHUNK_BYTES, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text, spans, factors: each document with its duplicate word spans removed, and the factors under them."""
    if not 1 <= anchor <= window:
        raise ValueError("anchor must lie between 1 and window")
    n = blocks_of(text_bytes(docs), chunk_bytes, 8)
    parts = blocks_of(n, PART_CHUNKS, 8)
    source = docs.select(F.pmod(F.xxhash64("doc_id", F.col("text").cast("string")), F.lit(n)).cast("int").alias("chunk"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def first(table: pa.Table) -> pa.Table:
        return _requests(table["chunk"][0].as_py(), _Chunk(table, window, anchor).anchors(), parts)

    def second(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not len(table):
            return _requests(0, Phrases(np.zeros(0, _U), np.zeros(0, np.int64)), parts)
        c = _Chunk(table, window, anchor)
        return _requests(table["chunk"][0].as_py(), c.phrases(repeated(c, replies)), parts)

    def repeated(c: _Chunk, replies: pa.Table) -> np.ndarray:
        found = c.anchors()
        return found.hashes[found.several | _answers(replies, 1, found, parts)]

    def third(table: pa.Table, replies: pa.Table) -> pa.Table:
        out: dict[str, list] = {f.name: [] for f in schema}
        if len(table):
            c = _Chunk(table, window, anchor)
            known = c.phrases(repeated(c, replies))
            _answers(replies, 2, known, parts)
            for base, w, phrase, at, _, doc, _ in c.parts:
                hit, k = np.zeros(len(phrase), bool), np.zeros(len(phrase), np.int64)
                if len(known.hashes):
                    k = np.searchsorted(known.hashes, phrase)
                    k[k == len(known.hashes)] = 0
                    hit = (known.hashes[k] == phrase) & (known.checks[k] == c.checks(w)) & (known.ids[k] < doc)
                at, k = at[hit], k[hit]
                cut, raw = np.searchsorted(at, w.offset), w.buf.tobytes()
                for i in range(len(w)):
                    a, b = int(w.offset[i]), int(w.offset[i + 1])
                    mine = slice(cut[i], cut[i + 1])
                    found = factors(at[mine] - a, known.ids[k[mine]], known.places[k[mine]], window)
                    spans = covered(found)
                    keep = np.ones(b - a, bool)
                    for x, y in spans:
                        keep[x:y] = False
                    kept = b" ".join(raw[x:y] for x, y in zip(w.start[a:b][keep].tolist(), w.end[a:b][keep].tolist()))
                    row = (None if c.ids[base + i] == NO_ID else int(c.ids[base + i]), b - a, int(b - a - keep.sum()), hashlib.sha256(kept).hexdigest(), kept.decode(), [{"start": x, "end": y} for x, y in spans], [{"start": x, "end": y, "source": s, "source_start": p} for x, y, s, p in found])
                    for values, value in zip(out.values(), row):
                        values.append(value)
        return pa.table({f.name: pa.array(out[f.name], f.type) for f in schema})

    schema = to_arrow_schema(_parse_datatype_string(_RESULT))
    by = source.groupBy("chunk")
    known = by.applyInArrow(first, _REQUEST).groupBy("part").applyInArrow(_index(1), _REPLY)
    earlier = by.cogroup(known.groupBy("chunk")).applyInArrow(second, _REQUEST).groupBy("part").applyInArrow(_index(2), _REPLY)
    return by.cogroup(known.union(earlier).groupBy("chunk")).applyInArrow(third, _RESULT)
