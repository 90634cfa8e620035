"""Benchmark decontamination by SimHash fingerprints of item-sized windows.

Texts are compared as multisets of word shingles (five words; a shorter item is one shingle of all
its words). Over each document slides a window as long as the benchmark item; a document shorter
than the item is one window. The items of a length have a multi-index: for each of the ``BLOCKS``
blocks of a fingerprint a table from the block's value to the items that have it. Two fingerprints
within ``RADIUS`` differ in at most ``NEAR`` bits of at least one block, so a window finds every item
within the radius by looking up, in each table, the values within ``NEAR`` bits of its own: it probes
the neighbours of its value or goes through the values that the table holds, whichever are fewer.
Only items found so are candidates. Candidates are verified exactly: the sum of the smaller counts of
all shingles over the sum of the larger ones is at least 0.75.

Windows that hold too few shingles of the items of their length to reach that get no fingerprint,
which loses nothing: the sum of the smaller counts is at most the number of such shingles. At a
similarity of exactly 0.75 a fingerprint differs in 44 of 256 bits on average, with a standard
deviation of 6; the radius is 79.

The benchmark is the query set. It is broadcast in parts of at most ``PART_BYTES`` of text, each
matched against all documents in one pass; a worker builds the index of a part once. Items and
documents without words, null or empty, match nothing; of repeated items each is found, repeated
documents get equal results, empty tables give empty results, and other columns are not read.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from takerank.llm import wordhash
from takerank.llm.cluster import ready

BITS = 256
BLOCKS = 16
NEAR = 4
RADIUS = BLOCKS * (NEAR + 1) - 1
PART_BYTES = 64 << 20
WINDOWS = 256  # fingerprinted at once
_SALTS = (np.arange(1, BITS // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)


def fingerprints(shingles: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """SimHash of shingles[first[i] : first[i] + count[i]] as rows of 16-bit blocks; counts are positive."""
    out = np.zeros((len(first), BLOCKS), dtype=np.uint16)
    for a in range(0, len(first), WINDOWS):
        n = count[a : a + WINDOWS]
        begins = np.cumsum(n) - n
        flat = np.repeat(first[a : a + WINDOWS] - begins, n) + np.arange(int(n.sum()))
        places, back = np.unique(flat, return_inverse=True)
        bits = np.unpackbits(wordhash.mix(shingles[places][:, None] + _SALTS).view(np.uint8), axis=1)[back]
        ones = np.add.reduceat(bits, begins, axis=0, dtype=np.int32)
        out[a : a + WINDOWS] = np.packbits(2 * ones >= n[:, None], axis=1).view(np.uint16)
    return out


def similarity(one: np.ndarray, two: np.ndarray) -> float:
    """Sum of the smaller counts over the sum of the larger ones."""
    both, place = np.unique(np.concatenate([one, two]), return_inverse=True)
    a = np.bincount(place[: len(one)], minlength=len(both))
    b = np.bincount(place[len(one) :], minlength=len(both))
    return float(np.minimum(a, b).sum() / np.maximum(a, b).sum())


def _neighbours(bits: int, near: int) -> np.ndarray:
    """All numbers of so many bits with at most ``near`` ones."""
    every = np.arange(1 << bits, dtype=np.uint16)
    return every[np.bitwise_count(every) <= near]


class MultiIndex:
    """Block tables of fingerprints: for each block the distinct values, sorted, and the items of each."""

    MASKS = _neighbours(16, NEAR)

    def __init__(self, prints: np.ndarray):
        self.tables = []
        for column in prints.T:
            order = np.argsort(column, kind="stable")
            values, first = np.unique(column[order], return_index=True)
            self.tables.append((values, np.append(first, len(order)), order))

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of a print, item): each pair once of which some block differs in at most NEAR bits."""
        found: list[np.ndarray] = []
        items = len(self.tables[0][2])
        for (values, first, order), mine in zip(self.tables, prints.T, strict=True):
            if len(values) <= len(self.MASKS):
                row, at = np.nonzero(np.bitwise_count(mine[:, None] ^ values) <= NEAR)
            else:
                probes = mine[:, None] ^ self.MASKS
                at = np.minimum(np.searchsorted(values, probes), len(values) - 1)
                row, column = np.nonzero(values[at] == probes)
                at = at[row, column]
            count = first[at + 1] - first[at]
            flat = np.repeat(first[at] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
            found.append(np.repeat(row, count) * items + order[flat])
        pairs = np.unique(np.concatenate(found))
        return pairs // items, pairs % items


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of the values are in known, which is sorted and not empty."""
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


class Benchmark:
    """Items by the number of their shingles, with their fingerprints."""

    def __init__(self, texts: list[str | None], percent: int = 75):
        self.percent, self.items, self.short = percent, [], defaultdict(lambda: defaultdict(list))
        for _, _, raw, offsets in wordhash.chunks(pa.array(texts, pa.string())):
            w = wordhash.words(raw, offsets)
            h, _, first = wordhash.shingles(w)
            self.items += [(h[a:b], int(n)) for a, b, n in zip(first[:-1], first[1:], np.diff(w.first), strict=True)]
        by: dict[int, list[int]] = defaultdict(list)
        for i, (h, n) in enumerate(self.items):
            if n >= 5:
                by[len(h)].append(i)
            elif n:
                self.short[n][int(h[0])].append(i)
        self.groups = {}
        for size, own in sorted(by.items()):
            flat = np.concatenate([self.items[i][0] for i in own])
            first = np.arange(len(own)) * size
            prints = fingerprints(flat, first, np.full(len(own), size))
            self.groups[size] = (np.array(own), prints, MultiIndex(prints), np.unique(flat))
        self.known = np.unique(np.concatenate([*(self.items[i][0] for own in by.values() for i in own), np.zeros(0, np.uint64)]))
        self.seen = np.zeros(1 << 20, dtype=bool)
        self.seen[(self.known >> np.uint64(44)).astype(np.int64)] = True

    def needed(self, window: int, item: int) -> int:
        """Least sum of smaller counts with which a window and an item of these sizes are similar enough."""
        return -(-self.percent * (window + item) // (100 + self.percent))

    def _known(self, h: np.ndarray) -> np.ndarray:
        hit = self.seen[(h >> np.uint64(44)).astype(np.int64)]
        maybe = np.flatnonzero(hit)
        hit[maybe] = _among(h[maybe], self.known)
        return hit

    def match(self, w: wordhash.Words) -> Iterator[tuple[int, int, float, int, int]]:
        """(row, item, similarity, first word, words) of the best window of each pair that is similar enough."""
        for n, wanted in self.short.items():
            h, at, first = wordhash.shingles(w, n)
            best: dict[tuple[int, int], int] = {}
            for p in np.flatnonzero(np.isin(h, np.array(list(wanted), dtype=np.uint64))):
                row = int(np.searchsorted(first, p, side="right")) - 1
                for item in wanted[int(h[p])]:
                    best.setdefault((row, item), int(at[p] - w.first[row]))
            yield from ((row, item, 1.0, start, n) for (row, item), start in best.items())
        if not self.groups:
            return
        h, _, first = wordhash.shingles(w)
        hit = self._known(h)
        if not hit.any():
            return
        total = np.concatenate([[0], np.cumsum(hit)])
        held = total[first[1:]] - total[first[:-1]]
        for row in np.flatnonzero(held >= self.needed(1, min(self.groups))).tolist():
            a, b = first[row], first[row + 1]
            yield from self._match_row(row, h[a:b], np.flatnonzero(hit[a:b]), int(w.first[row + 1] - w.first[row]))

    def _match_row(self, row: int, h: np.ndarray, hits: np.ndarray, words: int) -> Iterator[tuple[int, int, float, int, int]]:
        """hits: places of the shingles that any item has."""
        for size, (own, prints, index, known) in self.groups.items():
            window = min(size, len(h))
            need = self.needed(window, size)
            if need > window or len(hits) < need:
                continue
            places = hits[_among(h[hits], known)]
            if len(places) < need:
                continue
            mark = np.zeros(len(h) + 1, dtype=np.int64)
            mark[places + 1] = 1
            total = np.cumsum(mark)
            starts = np.flatnonzero(total[window:] - total[:-window] >= need)
            if not len(starts):
                continue
            best: dict[int, tuple[float, int]] = {}
            for k in range(0, len(starts), WINDOWS):
                some = starts[k : k + WINDOWS]
                mine = fingerprints(h, some, np.full(len(some), window))
                place, j = index.candidates(mine)
                near = np.bitwise_count(mine[place] ^ prints[j]).sum(axis=1) <= RADIUS
                for start, item in zip(some[place[near]].tolist(), own[j[near]].tolist(), strict=True):
                    s = similarity(h[start : start + window], self.items[item][0])
                    if 100 * s >= self.percent - 1e-9 and s > best.get(item, (0.0, 0))[0]:
                        best[item] = (s, start)
            yield from ((row, item, s, start, min(window + 4, words)) for item, (s, start) in best.items())


_built: dict[tuple[str, int], Benchmark] = {}


def _index(shared: Broadcast, percent: int) -> Benchmark:
    """The index of a broadcast part, built once a worker; a worker keeps the last one."""
    name, _, texts = shared.value
    if (name, percent) not in _built:
        _built.clear()
        _built[name, percent] = Benchmark(texts, percent)
    return _built[name, percent]


def _parts(benchmark: DataFrame) -> list[Broadcast]:
    """The benchmark as broadcasts of (ids, texts), each of about PART_BYTES of text at most, or a single longer item."""
    spark = ready(benchmark.sparkSession)
    rows = benchmark.select(F.col("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    parts = max(1, -(-2 * total // PART_BYTES)) if total > PART_BYTES else 1
    out = []
    for part in range(parts):
        own = rows if parts == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        found = own.collect()  # a part of the stated query set, bounded above
        out.append(spark.sparkContext.broadcast((uuid.uuid4().hex, [r.item_id for r in found], [r.text for r in found])))
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, item_id, similarity, start_word and n_words of the best window, for each pair of a row of docs and an item it holds."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kinds = (rows.dtypes[0][1], dict(benchmark.dtypes)["item_id"])

    def found(shared: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = _index(shared, percent)
            for batch in batches:
                out = [
                    (row + r, item, s, start, n)
                    for row, _, raw, offsets in wordhash.chunks(batch.column(1))
                    for r, item, s, start, n in index.match(wordhash.words(raw, offsets))
                ]
                if out:
                    row, item, s, start, n = zip(*out, strict=True)
                    ids = shared.value[1]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array([ids[i] for i in item]), pa.array(s), pa.array(start, pa.int64()), pa.array(n, pa.int64())], names=["doc_id", "item_id", "similarity", "start_word", "n_words"])

        return rows.mapInArrow(run, f"doc_id {kinds[0]}, item_id {kinds[1]}, similarity double, start_word long, n_words long")

    return reduce(DataFrame.unionByName, (found(x) for x in _parts(benchmark)))


def decontaminate(docs: DataFrame, benchmark: DataFrame, percent: int = 75) -> DataFrame:
    """The rows of docs that hold no item of the benchmark, unchanged."""

    def without(docs: DataFrame, shared: Broadcast) -> DataFrame:
        place = docs.columns.index("text")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = _index(shared, percent)
            for batch in batches:
                clean = np.ones(batch.num_rows, dtype=bool)
                for row, _, raw, offsets in wordhash.chunks(batch.column(place)):
                    clean[[row + m[0] for m in index.match(wordhash.words(raw, offsets))]] = False
                yield batch.filter(pa.array(clean))

        return docs.mapInArrow(run, docs.schema)

    return reduce(without, _parts(benchmark), docs)
