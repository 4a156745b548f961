"""Documents with SimHash fingerprints a few bits apart, by a generalised pigeonhole search.

1. A fingerprint has a bit set where more than half of the hashes of a text's word shingles (repeats counted) have it.
   Equal fingerprints are one class from here on.
2. Bits are grouped by their correlation over all classes into partitions of about equal width (``distance + 1``, at least 3), so that
   skew gathers in few values of few partitions.
3. If two fingerprints differ in at most ``distance`` bits, then for any thresholds t_i >= -1 whose sum is
   ``distance - partitions + 1`` they differ in at most t_i bits within some partition i. Every class chooses its own
   thresholds by dynamic programming on estimated candidate counts: each half of a partition has an exact table of how many
   classes lie within each distance of a value, and halves count as independent. A class in a crowded value of one
   partition so passes that partition by and probes another one more widely.
4. A class is stored under its value in every partition and probes all values within its thresholds. Buckets are verified
   exactly; a bucket gives links that join what its verified pairs join (no more than its rows), never all its pairs.
   Crowded buckets are dealt again by parts of the bits that they do not fix, to which the same principle applies with
   thresholds 0, until they are small. Nothing is capped: rows of a bucket are distinct, so fixed bits bound it.

Defined cases: null, empty and blank texts have fingerprint 0 and link like any other; rows sharing a doc_id are separate
texts of that id; a null doc_id names no component unless no member has an id. Other columns are not looked at.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import mix64, slices, stored, utf8
from evalspark.llm.components import components

BITS = 64
SEED = 42
BUCKET = 2048
PROBE_COST = 4.0
_CHUNK = 1 << 15
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SOLID = np.ones(256, bool)
_SOLID[[9, 10, 11, 12, 13, 32]] = False
_ONE = np.uint64(1)


def _spaced(data: np.ndarray, off: np.ndarray):
    """Lower-cased words with one blank after each, the bounds of each word, and the number of words per text."""
    solid = _SOLID[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last[:-1] &= ~solid[1:] | edge[1:-1]
    start = np.flatnonzero(first)
    size = np.flatnonzero(last) + 1 - start
    put = np.cumsum(size + 1) - (size + 1)
    out = np.full(int((size + 1).sum()), 32, np.uint8)
    out[np.flatnonzero(solid) + np.repeat(put - (np.cumsum(size) - size), size) - np.repeat(start - (np.cumsum(size) - size), size)] = _FOLD[data[solid]]
    return out.tobytes(), put, put + size, np.diff(np.searchsorted(start, off))


def fingerprints(data: np.ndarray, off: np.ndarray, size: int) -> np.ndarray:
    """64-bit fingerprint of each text."""
    n_texts = len(off) - 1
    if not len(data):
        return np.zeros(n_texts, np.uint64)
    buf, begin, end, n = _spaced(data, off)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    stop = np.cumsum(count)
    at = np.repeat(np.cumsum(n) - n, count) + np.arange(int(stop[-1])) - np.repeat(stop - count, count)
    owner = np.repeat(np.arange(n_texts), count)
    a, b = begin[at], end[at + np.repeat(np.minimum(n, size), count) - 1]
    ones = np.zeros((n_texts, BITS), np.int64)
    for i in range(0, len(at), _CHUNK):
        hashed = [xxhash.xxh64_intdigest(buf[x:y], SEED) for x, y in zip(a[i:i + _CHUNK].tolist(), b[i:i + _CHUNK].tolist())]
        bits = _unpack(np.array(hashed, np.uint64))
        own = owner[i:i + _CHUNK]
        cuts = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1])
        ones[own[cuts]] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int64)
    return _pack(2 * ones > count[:, None])


def _unpack(prints: np.ndarray) -> np.ndarray:
    """One row of 64 zeros and ones per fingerprint, lowest bit first."""
    return np.unpackbits(prints.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, BITS)


def _pack(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


def _print_rows(size: int):
    def fn(batches: Iterator[pa.RecordBatch]):
        for batch in slices(batches, "text"):
            prints = fingerprints(*utf8(batch.column("text")), size)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints.view(np.int64))], ["doc_id", "print"])
    return fn


def document_prints(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, print) of every row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_print_rows(size), "doc_id long, print long")


def _prints(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("print").to_numpy(zero_copy_only=False).view(np.uint64)


def _counted(name: str, cells: int, count):
    """Sums an array of ``cells`` counts over a task's batches; one row per cell that is not zero."""
    def fn(batches: Iterator[pa.RecordBatch]):
        total = np.zeros(cells, np.int64)
        for batch in batches:
            total += count(_prints(batch))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], [name, "n"])
    return fn


def _table(prints: DataFrame, cells: int, count) -> np.ndarray:
    """Counts over all classes: ``cells`` numbers, whatever the size of the table."""
    rows = prints.mapInArrow(_counted("cell", cells, count), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(cells, np.int64)
    for cell, n in rows:
        out[cell] = n
    return out


def _both_set(prints: np.ndarray) -> np.ndarray:
    bits = _unpack(prints).astype(np.float64)
    return (bits.T @ bits).astype(np.int64).ravel()


def group_bits(together: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of about equal width: each group takes the free bit most correlated with it in turn."""
    p = np.diag(together) / max(n, 1)
    spread = np.sqrt(np.maximum(np.outer(p * (1 - p), p * (1 - p)), 1e-18))
    strength = np.abs(together / max(n, 1) - np.outer(p, p)) / spread
    np.fill_diagonal(strength, 0.0)
    free, groups = set(range(BITS)), []
    for g in range(parts):
        width = BITS // parts + (g < BITS % parts)
        left = sorted(free)
        group = [max(left, key=lambda b: (strength[b, left].sum(), -b))]
        free.remove(group[0])
        while len(group) < width:
            best = max(sorted(free), key=lambda b: (strength[b, group].sum(), -b))
            group.append(best)
            free.remove(best)
        groups.append(group)
    return groups


def _value(prints: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(prints), np.int64)
    for j, b in enumerate(bits):
        out |= ((prints >> np.uint64(b)) & _ONE).astype(np.int64) << j
    return out


def _halves(groups: list[list[int]]) -> list[list[int]]:
    return [h for g in groups for h in (g[:len(g) // 2], g[len(g) // 2:])]


def _half_values(halves: list[list[int]], room: int):
    def count(prints: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(_value(prints, h), minlength=room) for h in halves])
    return count


def _by_distance(counts: np.ndarray, width: int, most: int) -> np.ndarray:
    """[a, v]: how many classes have a half value exactly a bits from v."""
    v = np.arange(1 << width)
    out = []
    for a in range(most + 1):
        flips = [sum(1 << b for b in c) for c in itertools.combinations(range(width), a)]
        out.append(sum((counts[v ^ f] for f in flips), np.zeros(1 << width, np.int64)))
    return np.array(out, np.float64)


class Allocation:
    """Thresholds of each class by dynamic programming; holds only tables of bounded size."""

    def __init__(self, groups: list[list[int]], counts: np.ndarray, n: int, distance: int):
        self.groups, self.distance, self.n = groups, distance, max(n, 1)
        self.halves = _halves(groups)
        self.near = [_by_distance(c[:1 << len(h)], len(h), distance) for h, c in zip(self.halves, counts)]
        self.flips = [[[0]] for _ in groups]
        for g, flips in zip(groups, self.flips):
            for a in range(1, distance + 1):
                flips.append([sum(1 << b for b in c) for c in itertools.combinations(range(len(g)), a)])

    def costs(self, prints: np.ndarray, i: int) -> np.ndarray:
        """[t + 1, class]: estimated candidates and probes of partition i at threshold t; nothing at -1."""
        left, right = (self.near[2 * i + s][:, _value(prints, self.halves[2 * i + s])] for s in (0, 1))
        out = [np.zeros(len(prints))]
        found, probes = np.zeros(len(prints)), 0
        for t in range(self.distance + 1):
            found = found + sum(left[a] * right[t - a] for a in range(t + 1)) / self.n
            probes += len(self.flips[i][t])
            out.append(found + PROBE_COST * probes)
        return np.array(out)

    def thresholds(self, prints: np.ndarray) -> np.ndarray:
        """[class, partition]: the cheapest thresholds with the sum that the principle asks for."""
        room = self.distance + 1  # t_i + 1 sum to this
        best = np.full((room + 1, len(prints)), np.inf)
        best[0] = 0
        chosen = []
        for i in range(len(self.groups)):
            cost = self.costs(prints, i)
            options = np.array([[best[s - u] + cost[u] if s >= u else np.full(len(prints), np.inf) for u in range(room + 1)] for s in range(room + 1)])
            chosen.append(options.argmin(axis=1))
            best = options.min(axis=1)
        left, out = np.full(len(prints), room), np.zeros((len(prints), len(self.groups)), np.int64)
        for i in range(len(self.groups) - 1, -1, -1):
            used = chosen[i][left, np.arange(len(prints))]
            out[:, i] = used - 1
            left = left - used
        return out


def _bucket_rows(allocation: Allocation):
    """Each class under its value in every partition (stored) and under the values that it probes besides."""
    masks = [np.uint64(sum(1 << b for b in g)) for g in allocation.groups]

    def fn(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            prints = _prints(batch)
            limits = allocation.thresholds(prints)
            for i, group in enumerate(allocation.groups):
                value = _value(prints, group)
                # A class that does not probe its own value still lies there for others to find.
                parts = [(value, prints, np.ones(len(prints), bool), limits[:, i] >= 0)]
                for t in range(1, allocation.distance + 1):
                    who = np.flatnonzero(limits[:, i] >= t)
                    for flip in allocation.flips[i][t] if len(who) else ():
                        parts.append((value[who] ^ flip, prints[who], np.zeros(len(who), bool), np.ones(len(who), bool)))
                for v, p, is_stored, probes in parts:
                    yield pa.RecordBatch.from_arrays([pa.array(v + (i << 40)), pa.array(np.full(len(v), masks[i]).view(np.int64)), pa.array(p.view(np.int64)),
                                                      pa.array(is_stored), pa.array(probes)], ["bucket", "fixed", "print", "stored", "probes"])
    return fn


_BUCKET_ROW = "bucket long, fixed long, print long, stored boolean, probes boolean"


def _deal_again(parts: int):
    """Rows of crowded buckets once for each of ``parts`` parts of the bits that their bucket leaves open."""
    def fn(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            bucket, fixed, prints = (batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("bucket", "fixed", "print"))
            for f in np.unique(fixed):
                at = np.flatnonzero(fixed == f)
                keep = pa.array(at)
                free = [b for b in range(BITS) if not int(f) >> b & 1]
                for r in range(parts):
                    mask = np.uint64(sum(1 << b for b in free[r::parts]))
                    new = mix64(bucket[at] ^ mix64(np.full(len(at), mask)) ^ mix64((prints[at] & mask) + np.uint64(r + 1)))
                    yield pa.RecordBatch.from_arrays([pa.array(new.view(np.int64)), pa.array(np.full(len(at), f | mask).view(np.int64)), pa.array(prints[at].view(np.int64)),
                                                      batch.column("stored").take(keep), batch.column("probes").take(keep)], ["bucket", "fixed", "print", "stored", "probes"])
    return fn


def _links(prints: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (smallest of its set, other) that join what the verified pairs join."""
    prints = np.unique(prints)
    n = len(prints)
    left, right = [], []
    for i in range(0, n, 512):
        near = np.bitwise_count(prints[i:i + 512, None] ^ prints[None, i:]) <= distance
        a, b = np.nonzero(near)
        keep = b > a
        left.append(a[keep] + i)
        right.append(b[keep] + i)
    a, b = np.concatenate(left), np.concatenate(right)
    label = np.arange(n)
    while len(a):
        new = label.copy()
        np.minimum.at(new, b, label[a])
        np.minimum.at(new, a, label[b])
        new = new[new]
        if (new == label).all():
            break
        label = new
    other = np.flatnonzero(label != np.arange(n))
    return prints[label[other]], prints[other]


def _bucket_links(distance: int):
    """Rows sorted by bucket: links of each bucket as it passes."""
    def out(a, b):
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    def fn(batches: Iterator[pa.RecordBatch]):
        held_bucket, held = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            bucket = np.concatenate([held_bucket, batch.column("bucket").to_numpy(zero_copy_only=False)])
            prints = np.concatenate([held, _prints(batch)])
            cuts = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1])
            for x, y in zip(cuts[:-1], cuts[1:]):
                yield out(*_links(prints[x:y], distance))
            held_bucket, held = bucket[cuts[-1]:], prints[cuts[-1]:]
        if len(held):
            yield out(*_links(held, distance))
    return fn


def links(prints: DataFrame, distance: int = 2, parts: int | None = None, bucket: int = BUCKET) -> DataFrame:
    """(a, b) over distinct fingerprints (column ``print``): joins whatever a chain of at most ``distance`` differing bits joins."""
    parts = parts or max(3, distance + 1)
    n = prints.count()
    groups = group_bits(_table(prints, BITS * BITS, _both_set).reshape(BITS, BITS), n, parts)
    halves = _halves(groups)
    room = 1 << max(len(h) for h in halves)
    counts = _table(prints, len(halves) * room, _half_values(halves, room)).reshape(len(halves), room)
    rows = prints.mapInArrow(_bucket_rows(Allocation(groups, counts, n, distance)), _BUCKET_ROW)
    found, level = [], 0
    while True:
        rows = stored(rows, "print-buckets")
        sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("c"), F.max("stored").alias("any_stored"), F.max("probes").alias("any_probe"))
        shared = stored(rows.join(sizes.filter("c > 1 and any_stored and any_probe").select("bucket", "c"), "bucket"), "print-shared")
        last = F.bit_count("fixed") > BITS - 3 * (distance + 1)  # at most 2 ** 8 distinct rows are left
        small = shared.filter((F.col("c") <= bucket) | last)
        found.append(small.select("bucket", "print").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_bucket_links(distance), "a long, b long"))
        crowded = shared.filter((F.col("c") > bucket) & ~last).drop("c")
        if not crowded.limit(1).count():
            break
        rows = crowded.mapInArrow(_deal_again(distance + 1), _BUCKET_ROW)
        level += 1
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return stored(out.distinct(), "print-links")


def near_prints(docs: DataFrame, size: int = 5, distance: int = 2, bucket: int = BUCKET) -> DataFrame:
    """One row per document: doc_id, print (as a signed long), fingerprint, component_id, kept."""
    prints = stored(document_prints(docs, size), "prints")
    classes = stored(prints.groupBy("print").agg(F.min("doc_id").alias("least")), "print-classes")
    labels = components(links(classes.select("print"), distance, bucket=bucket))
    named = classes.join(labels.select(F.col("node").alias("print"), "label"), "print", "left").withColumn("label", F.coalesce("label", "print"))
    names = named.groupBy("label").agg(F.min("least").alias("component_id"))
    ids = named.join(names, "label").select("print", "component_id")
    return prints.join(ids, "print").select("doc_id", "print", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id",
                                            F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
