"""Near-duplicate detection: banded MinHash, Odd sketches and exact confirmation.

A document's set is its distinct word shingles (``wordhash``). Documents whose sets are equal form a
class, and only classes are compared. MinHash bands put classes into buckets. Two passes over the
buckets find every link that matters for the components:

1. every member is compared with the smallest member of its bucket (a star, linear in the bucket);
2. where a bucket still holds members of several components, its members of the smaller components
   are compared with all members of other components, in blocks of bounded size.

A pair is first judged by Odd sketches. In pass 1 it is the parity bitmap of the MinHash samples,
whose XOR population count estimates the similarity; a pair goes on if the count is at most
``SPARE`` standard deviations above that of the threshold, which by the normal approximation holds
for about 99.8 % of the pairs at the threshold itself and more above it; what is left out here is left to pass 2. In pass 2 it is the parity bitmap of the whole set,
a sample that leaves nothing out: there the count is at most the number of shingles in which the sets
differ, so the threshold itself drops no link. What remains is confirmed on the full sets. Pairs inside
a component need no comparison, so a group of n copies costs n comparisons and not n * n.

A class is known by a 64-bit digest of its set. A second digest tells sets apart that share the first;
such classes get new keys, so members of a class agree in 128 bits.

Rows without text or words, and rows without an id, have no partners; the latter get a null
component and stay. Rows that share an id share its component where their texts do. Empty tables give
empty results; columns other than the id and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from takerank.llm import wordhash
from takerank.llm.cluster import Scratch, free_name, join_spread, ready

ROWS = 4  # MinHash values in a band
BANDS = 28  # a pair of similarity 0.75 shares no band with probability (1 - 0.75**4) ** 28 = 0.00002
SAMPLES = ROWS * BANDS
SKETCH_BITS = 512
BLOCK = 64  # members of a block in pass 2
BLOCK_BYTES = 1 << 17  # and their bitmaps together, but for single larger ones; a batch for Python holds pairs of blocks
DEAL = 64  # blocks that a task compares with one block
SPARE = 3
SEED = 20240229


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(SEED)
    return draw.integers(0, 2**63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1), draw.integers(0, 2**63, SAMPLES, dtype=np.uint64)


def _row_sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, sorted distinct shingles of a run of rows, offsets of the rows)."""
    for row, _, raw, offsets in wordhash.chunks(column):
        h, _, first = wordhash.shingles(wordhash.words(raw, offsets), k)
        parts = [np.unique(h[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
        yield row, np.concatenate([*parts, np.zeros(0, np.uint64)]), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def set_keys(sets: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each row's set; 0 for an empty one."""
    filled = np.flatnonzero(np.diff(offsets) > 0)
    out = np.zeros((2, len(offsets) - 1), dtype=np.uint64)
    if len(filled):
        start = offsets[:-1][filled]
        for i, (one, two) in enumerate(((0x1D8E4E27C47D124F, 0xEB44ACCAB455D165), (0x8BB84B93962EACC9, 0x4B33A62ED433D4A3))):
            total = np.add.reduceat(wordhash.mix(sets + np.uint64(one)), start)
            other = np.bitwise_xor.reduceat(wordhash.mix(sets ^ np.uint64(two)), start)
            out[i, filled] = wordhash.mix(wordhash.mix(total) + other + np.diff(offsets)[filled].astype(np.uint64))
    return out[0], out[1]


def sketch_batch(column: pa.Array, k: int, key_bits: int = 64) -> list[pa.Array]:
    """n_shingles, key, check, bands and Odd sketch (as 64-bit integers) of each row."""
    a, b = _permutations()
    counts, keys, checks, bands, odd = [], [], [], [], []
    for _, sets, offsets in _row_sets(column, k):
        n = len(offsets) - 1
        filled = np.flatnonzero(np.diff(offsets) > 0)
        counts.append(np.diff(offsets))
        key, check = set_keys(sets, offsets)
        keys.append(key >> np.uint64(64 - key_bits))
        checks.append(check)
        least = np.zeros((SAMPLES, n), dtype=np.uint64)
        if len(filled):
            start = offsets[:-1][filled]
            for i in range(SAMPLES):
                least[i, filled] = np.minimum.reduceat(sets * a[i] + b[i], start)
        least = wordhash.mix(least + np.arange(SAMPLES, dtype=np.uint64)[:, None])
        band = np.zeros((BANDS, n), dtype=np.uint64)
        for i in range(ROWS):
            band = wordhash.mix(band + least[i::ROWS])
        bands.append(band.T)
        bits = np.zeros((n, SKETCH_BITS), dtype=np.uint8)
        place = (least >> np.uint64(23)) % np.uint64(SKETCH_BITS)
        for i in range(SAMPLES):
            bits[np.arange(n), place[i]] ^= 1
        odd.append(np.packbits(bits, axis=1).view(np.int64))
    if not counts:
        empty = pa.array([], pa.int64())
        return [empty, empty, empty, pa.array([], pa.list_(pa.int64())), pa.array([], pa.list_(pa.int64()))]

    def lists(parts: list[np.ndarray]) -> pa.Array:
        rows = np.ascontiguousarray(np.concatenate(parts)).view(np.int64)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.reshape(-1)))

    return [pa.array(np.concatenate(counts)), pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(checks).view(np.int64)), lists(bands), lists(odd)]


def _sketches(docs: DataFrame, k: int, key_bits: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *sketch_batch(batch.column(1), k, key_bits)], names=["doc_id", "n_shingles", "key", "check", "bands", "odd"])

    return docs.mapInArrow(run, f"doc_id {docs.dtypes[0][1]}, n_shingles long, key long, check long, bands array<long>, odd array<long>")


def parity_width(n: int) -> int:
    """Bits of the parity bitmap of a whole set of n: a power of two, at least 8 a shingle."""
    return max(64, 1 << (8 * n - 1).bit_length())


def parity(shingle_set: np.ndarray) -> bytes:
    """Odd sketch of a whole set: bit i is the parity of the number of shingles that hash to i."""
    width = parity_width(len(shingle_set))
    place = (wordhash.mix(shingle_set + np.uint64(0x2545F4914F6CDD1D)) % np.uint64(width)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=width) & 1).astype(np.uint8)).tobytes()


def _fold(bits: np.ndarray, width: int) -> np.ndarray:
    """Parity bitmaps (rows of 64-bit integers) as they would be at a smaller width."""
    while bits.shape[1] * 64 > width:
        # place % width keeps the low part of the place, so halves are laid over each other
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def most_ones(samples: int, percent: int, width: int) -> float:
    """XOR population count that a pair at the threshold stays below, with SPARE standard deviations to spare."""
    apart = 1 - percent / 100
    differing, spread = 2 * samples * apart, 2 * math.sqrt(samples * apart * (1 - apart))  # each sample that differs sets two bits
    mean = width / 2 * (1 - math.exp(-2 * differing / width))
    folded = width / 4 * (1 - math.exp(-4 * differing / width)) - differing * math.exp(-4 * differing / width)
    return mean + SPARE * math.sqrt(max(folded, 1) + (math.exp(-2 * differing / width) * spread) ** 2)


def block_pairs(left: list, right: list, same: bool, percent: int, band: int) -> list[tuple[int, int]]:
    """Pairs of members with different labels whose parity bitmaps allow a link. A member: (key, label, n, bitmap, bands).

    Of the buckets that two members share, only that of the first band gives the pair.
    """
    share = (100 - percent) / (100 + percent)  # linked sets differ in at most this share of their summed sizes
    found: list[tuple[int, int]] = []
    by: list[dict[int, tuple]] = []
    for side in (left, right):
        widths: dict[int, list] = {}
        for m in side:
            widths.setdefault(len(m[3]) * 8, []).append(m)
        by.append({w: (np.array([m[0] for m in ms]), np.array([m[1] for m in ms]), np.array([m[2] for m in ms]), np.frombuffer(b"".join(m[3] for m in ms), dtype=np.uint64).reshape(len(ms), -1), np.array([m[4] for m in ms])) for w, ms in widths.items()})
    for w, (keys, labels, sizes, bits, bands) in by[0].items():
        for v, (keys2, labels2, sizes2, bits2, bands2) in by[1].items():
            if max(w, v) > 4 * min(w, v):
                continue
            width = min(w, v)
            one, two = _fold(bits, width), _fold(bits2, width)
            for i in range(len(keys)):
                fits = (labels2 != labels[i]) & (100 * np.minimum(sizes2, sizes[i]) >= percent * np.maximum(sizes2, sizes[i]))
                if same:
                    fits &= keys2 > keys[i]
                j = np.flatnonzero(fits)
                if len(j):
                    ones = np.bitwise_count(two[j] ^ one[i]).sum(axis=1)
                    j = j[ones <= (sizes2[j] + sizes[i]) * share + 1e-6]
                    common = bands2[j] == bands[i]
                    j = j[bands[i][common.argmax(axis=1)] == band]
                    found += [(min(int(keys[i]), int(x)), max(int(keys[i]), int(x))) for x in keys2[j]]
    return found


def _sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """key, n, shingles and parity bitmap of the classes in wanted (doc_id, key, check), from the texts of their documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            want = batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            for row, sets, offsets in _row_sets(batch.column(3), k):
                checks = set_keys(sets, offsets)[1]
                hit = [i for i in range(len(checks)) if checks[i] == want[row + i]]
                own = [sets[offsets[i] : offsets[i + 1]] for i in hit]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(1).take(pa.array([row + i for i in hit], pa.int64())),
                        pa.array([len(s) for s in own], pa.int64()),
                        pa.array([s.view(np.int64) for s in own], pa.list_(pa.int64())),
                        pa.array([parity(s) for s in own], pa.binary()),
                    ],
                    names=["key", "n", "shingles", "parity"],
                )

    rows = docs.join(wanted, "doc_id").select("doc_id", "key", "check", "text")
    return rows.mapInArrow(run, "key long, n long, shingles array<long>, parity binary")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of a table whose full sets reach the threshold; each set occurs once in sets."""
    one = sets.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("key").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))
    held = join_spread(pairs, two, "b")
    joined = join_spread(held, one, "a", counted=pairs, by=["a", "b"]).withColumn("both", F.size(F.array_intersect("sa", "sb")))
    return joined.where(100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b").distinct()


def components(links: DataFrame, work: Scratch) -> DataFrame:
    """Connected components of links (a, b): key and the smallest key it reaches, for all keys but those smallest.

    Alternates large-star and small-star steps until the links are stars around the smallest keys.
    Each step is an aggregation and a join, in which the links of one key do not meet in a task, and its
    result is a table in the shared folder.
    """
    star = work.stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "stars")
    state = None
    while True:
        now = star.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("x")).first()
        if now == state or not now.n:
            return star.select(F.col("u").alias("key"), F.col("v").alias("label"))
        state = now
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = work.stored(join_spread(both, least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = join_spread(large, least, "u")
        star = work.stored(small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "stars")


def _classes(rows: DataFrame, work: Scratch) -> tuple[DataFrame, DataFrame]:
    """The rows and their classes, told apart by both digests."""

    def grouped(rows: DataFrame) -> DataFrame:
        usable = rows.where("doc_id IS NOT NULL AND n_shingles > 0")
        return work.stored(usable.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n"), F.min("check").alias("check"), F.max("check").alias("other"), F.first("bands").alias("bands"), F.first("odd").alias("odd")), "classes")

    classes = grouped(rows)
    clash = classes.where("check != other").select("key", F.lit(True).alias("clash"))
    if clash.limit(1).count():
        new = F.when(F.col("clash"), F.xxhash64("key", "check")).otherwise(F.col("key"))
        rows = work.stored(rows.join(clash, "key", "left").withColumn("key", new).drop("clash"), "sketches")
        classes = grouped(rows)
    return rows, classes


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 75, key_bits: int = 64) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, a row for each row of docs (doc_id, text, ...).

    percent: documents are linked if 100 * intersection >= percent * union of their sets.
    key_bits: of the first digest of a set; fewer only to test what happens to sets that share it.
    """
    spark = ready(docs.sparkSession)
    work = Scratch(spark, "near")
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    rows = work.stored(_sketches(texts, k, key_bits), "sketches")
    work.fit(rows.count())
    rows, classes = _classes(rows, work)
    buckets = classes.select(F.explode("bands").alias("band"), "key")
    shared = buckets.groupBy("band").agg(F.min("key").alias("pivot"), F.count("*").alias("size")).where("size > 1").select("band", "pivot")
    members = work.stored(buckets.join(shared, "band"), "members")

    # pass 1: stars, judged by the Odd sketches of the MinHash samples
    brief = classes.select("key", "n", "odd")
    pairs = work.stored(members.where("key != pivot").select(F.col("pivot").alias("a"), F.col("key").alias("b")).distinct(), "pairs")
    both = pairs.join(brief.select(F.col("key").alias("b"), F.col("n").alias("nb"), F.col("odd").alias("ob")), "b")
    both = join_spread(both, brief.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("odd").alias("oa")), "a", counted=pairs, by=["a", "b"])
    ones = reduce(lambda x, y: x + y, (F.bit_count(F.col("oa")[i].bitwiseXOR(F.col("ob")[i])) for i in range(SKETCH_BITS // 64)))
    most = most_ones(SAMPLES, percent, SKETCH_BITS)
    pairs = work.stored(both.where((100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (ones <= most)).select("a", "b"), "pairs")
    sets = work.stored(_sets(texts, classes.select("doc_id", "key", "check").join(members.select("key").distinct(), "key", "left_semi"), k), "sets")
    links = work.stored(_confirm(pairs, sets, percent), "links")
    labels = components(links, work)

    # pass 2: what is left between components, judged by the parity bitmaps of the whole sets
    crossing = work.stored(_crossing(members, labels, sets.join(classes.select("key", "bands"), "key"), percent, work), "crossing")
    more = _confirm(crossing, sets, percent)
    labels = components(links.unionByName(more), work)

    named = work.stored(classes.select("key", F.col("doc_id").alias("least")).join(labels, "key", "left").withColumn("label", F.coalesce("label", "key")), "labels")
    roots = named.groupBy("label").agg(F.min("least").alias("root"))
    named = work.stored(join_spread(named, roots, "label").select("key", "root"), "roots")
    work.clear("sketches", "roots")
    out = join_spread(rows.select("doc_id", "n_shingles", "key"), named, "key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _crossing(members: DataFrame, labels: DataFrame, sets: DataFrame, percent: int, work: Scratch) -> DataFrame:
    """Pairs of members of a bucket that lie in different components and may be linked."""
    held = members.select("band", "key").join(labels, "key", "left").withColumn("label", F.coalesce("label", "key")).join(sets.select("key", "n").dropDuplicates(["key"]), "key")
    size = held.groupBy("band", "label").agg(F.count("*").alias("count"), F.sum(2 * F.col("n")).alias("bytes"))  # a bitmap has one to two bytes a shingle
    major = F.max_by(F.struct("label", "count", "bytes"), F.struct("count", "label"))
    mixed = size.groupBy("band").agg(major.alias("major"), F.sum("count").alias("count"), F.sum("bytes").alias("bytes"), F.count("*").alias("labels")).where("labels > 1").drop("labels")
    held = held.drop("n").join(mixed, "band").withColumn("minor", F.col("label") != F.col("major.label"))
    minors = F.ceil(F.greatest((F.col("count") - F.col("major.count")) / BLOCK, (F.col("bytes") - F.col("major.bytes")) / BLOCK_BYTES))
    majors = F.ceil(F.greatest(F.col("major.count") / BLOCK, F.col("major.bytes") / BLOCK_BYTES))
    held = held.withColumns({"minors": minors, "deals": F.ceil((minors + majors) / DEAL), "block": F.pmod(F.xxhash64("key"), F.when(F.col("minor"), minors).otherwise(majors))})
    held = held.select("band", "minors", "deals", "minor", "block", "key", "label").join(sets.select("key", "n", "parity", "bands").dropDuplicates(["key"]), "key")
    block = work.stored(held.groupBy("band", "minors", "deals", "minor", "block").agg(F.collect_list(F.struct("key", "label", "n", "parity", "bands")).alias("rows")), "blocks")
    # each block of the smaller components meets the others in several tasks, at most DEAL or so in one
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = block.where("minor").select("band", F.col("block").alias("i"), each("deals").alias("deal"), F.col("rows").alias("one"))
    right = block.select("band", each("minors").alias("i"), F.pmod("block", "deals").alias("deal"), "minor", F.col("block").alias("j"), F.col("rows").alias("two"))
    tasks = left.join(right, ["band", "i", "deal"]).where("NOT minor OR i <= j")
    tasks = tasks.select("one", "two", "band", (F.col("minor") & (F.col("i") == F.col("j"))).alias("same"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                one, two = ([(m["key"], m["label"], m["n"], m["parity"], m["bands"]) for m in batch.column(c)[r].as_py()] for c in (0, 1))
                found = block_pairs(one, two, batch.column(3)[r].as_py(), percent, batch.column(2)[r].as_py())
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in found], pa.int64()), pa.array([p[1] for p in found], pa.int64())], names=["a", "b"])

    return tasks.mapInArrow(run, "a long, b long").distinct()


def deduplicate(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """docs without near duplicates: of each component the document with the smallest id stays.

    Rows equal in id and text count as one document. Rows without an id stay, all of them.
    """
    verdict = near_duplicates(docs, k, percent).where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("kept").alias("_kept"), F.count("*").alias("_rows"))
    flag = free_name(docs, "near_kept")
    odd = verdict.where("NOT _kept OR _rows > 1").select("doc_id", F.col("_kept").alias(flag))  # what is neither is left as it is
    marked = docs.join(odd, "doc_id", "left")
    once = marked.where(F.col(flag).isNull()).select(*docs.columns)
    return once.unionByName(marked.where(flag).select(*docs.columns).dropDuplicates(["doc_id", "text"]))
