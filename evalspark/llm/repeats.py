"""Removal of repeated byte strings of a minimum length, over documents of any number.

1. Equal texts are one text from here on (grouped by a 128-bit hash), written once, bucketed by that hash.
2. Every window of ``length`` bytes names an anchor: the 32 bytes in it with the least hash. Equal windows name equal
   anchors at the same place, so only anchors that occur twice can hold repeats. Consecutive windows with one anchor are a context.
3. Anchor rows are range-partitioned and sorted by anchor, context and place; a common anchor spreads over many
   partitions. Equal contexts side by side are repeats already. Contexts that share only their anchor go on.
4. Those are dealt to shards by anchor. A shard builds the Burrows-Wheeler transform of its contexts and expands
   intervals breadth-first up to the minimum length (``bwt``): suffixes whose common prefix is still open are repeats.
   An anchor with more contexts than a shard should hold is dealt anew by cores, strings just short of the minimum
   length: a shared window holds a shared core at one of nine places. Cores still crowded then are counted window by window.
5. Marked windows meet their texts once more; runs of removed bytes, the kept text and its checksum are made there.

Defined cases: a null text is empty; texts below the minimum length have no window; windows never cross texts; a text that
occurs twice loses all its bytes if it has ``length`` or more; null and repeated ids do not matter here.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.bwt import repeated_starts
from evalspark.llm.common import hash_pair, inverse_powers, mix64, prefix_hash, slices, stored, utf8
from evalspark.session import work_path

ANCHOR = 32
SHARD_BYTES = 1 << 20
CROWDED = 2000
CORE_STEP = 21  # windows of a core start at most this far before it
_MIXER = np.uint64(0xD6E8FEB86659FD93)
_ANCHOR_FIELDS = ["a", "o1", "o2", "c", "t1", "t2", "p"]
_ANCHOR_SCHEMA = "a long, o1 int, o2 int, c long, t1 long, t2 long, p int"
_CONTEXT = ["a", "o1", "o2", "c"]


def text_key():
    return hash_pair(F.coalesce("text", F.lit("")))


def distinct_texts(docs: DataFrame) -> DataFrame:
    """(t1, t2, text, copies), stored once and bucketed by (t1, t2): later joins ship only the other side."""
    spark = docs.sparkSession
    t1, t2 = text_key()
    texts = (docs.select(t1.alias("t1"), t2.alias("t2"), F.coalesce("text", F.lit("")).alias("text"))
             .groupBy("t1", "t2").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies")))
    name = f"repeat_texts_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (texts.write.format("parquet").option("path", work_path(spark, "repeat-texts")).option("compression", "zstd")
     .bucketBy(buckets, "t1", "t2").saveAsTable(name))
    return spark.table(name)


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, from prefix and suffix minima of blocks."""
    n = len(x)
    rows = -(-n // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    grid = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n - width + 1], ahead[width - 1:n])


def anchors(data: np.ndarray, off: np.ndarray, length: int):
    """(text, anchor hash, o1, o2, context hash, p): windows from p - o1 to p - o2 have their anchor at p."""
    empty = (np.zeros(0, np.int64),) * 6
    n = len(data)
    if n < length:
        return empty
    sums, back = prefix_hash(data), inverse_powers(n + 1)
    grams = (sums[ANCHOR:] - sums[:-ANCHOR]) * back[:n - ANCHOR + 1]
    ordered = ((grams * _MIXER) & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    chosen = (_sliding_least(ordered, length - ANCHOR + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    ok = np.zeros(len(chosen), bool)
    wide = np.maximum(np.diff(off) - length + 1, 0)
    at = np.repeat(off[:-1] - (np.cumsum(wide) - wide), wide) + np.arange(int(wide.sum()))
    ok[at] = True
    start = np.flatnonzero(ok)
    if not len(start):
        return empty
    chosen = chosen[start]
    new = np.ones(len(start), bool)
    new[1:] = chosen[1:] != chosen[:-1]
    first = np.flatnonzero(new)
    s1, s2, p = start[first], start[np.append(first[1:], len(start)) - 1], chosen[first]
    text = np.searchsorted(off, p, side="right") - 1
    context = mix64((sums[s2 + length] - sums[s1]) * back[s1])
    return text, mix64(grams[p]).view(np.int64), p - s1, p - s2, context.view(np.int64), p - off[text]


def _anchor_rows(length: int):
    def fn(batches: Iterator[pa.RecordBatch]):
        for batch in slices(batches, "text"):
            text, a, o1, o2, c, p = anchors(*utf8(batch.column("text")), length)
            t1, t2 = (batch.column(k).to_numpy()[text] for k in ("t1", "t2"))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(o1, pa.int32()), pa.array(o2, pa.int32()), pa.array(c), pa.array(t1),
                                              pa.array(t2), pa.array(p, pa.int32())], _ANCHOR_FIELDS)
    return fn


def _shared(batches: Iterator[pa.RecordBatch]):
    """Sorted anchor rows: drops anchors seen once, numbers equal contexts (``run``: their count on the first row, else 0).

    Rows at the ends of a partition may go on in the next one, so they stay. Only one run of equal contexts is held, as
    its first row and a count; rows leave as they come, the first one when the run ends.
    """
    def out(rows, run):
        return pa.RecordBatch.from_arrays([pa.array(c) for c in rows] + [pa.array(run.astype(np.int64))], [*_ANCHOR_FIELDS, "run"])

    held, held_run, seen_before, at_start = None, 0, False, True  # the open run's first row; was its anchor seen before it
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [batch.column(f).to_numpy() for f in _ANCHOR_FIELDS]
        n = len(rows[0])
        if held is None:
            held, held_run = [c[:1] for c in rows], 1
            rows = [c[1:] for c in rows]
            n -= 1
        if not n:
            continue
        same_a = np.concatenate([rows[0][:1] == held[0], rows[0][1:] == rows[0][:-1]])
        same_context = same_a.copy()
        for k in (1, 2, 3):
            same_context &= np.concatenate([rows[k][:1] == held[k], rows[k][1:] == rows[k][:-1]])
        follow = np.flatnonzero(same_context)
        if len(follow):
            yield out([c[follow] for c in rows], np.zeros(len(follow), np.int64))
        heads = np.flatnonzero(~same_context)
        # Runs that end in this batch: the held one and all but the last that begins here.
        bounds = np.append(heads, n)
        lengths = np.diff(bounds)
        if not len(heads):
            held_run += n
            continue
        held_run += int(heads[0])
        firsts = [np.concatenate([h, c[heads]]) for h, c in zip(held, rows)]
        counts = np.concatenate([[held_run], lengths])
        before = np.concatenate([[seen_before], same_a[heads]])
        after = np.append(same_a[heads], False)
        keep = before | after | (counts > 1)
        if at_start:
            keep[0], at_start = True, False
        keep[-1] = False
        if keep.any():
            i = np.flatnonzero(keep)
            yield out([c[i] for c in firsts], counts[i])
        held, held_run, seen_before = [c[-1:] for c in firsts], int(lengths[-1]), bool(before[-1])
    if held is not None:
        yield out(held, np.array([held_run]))


def _contexts(length: int):
    """Bytes of the wanted contexts of each text."""
    def fn(batches: Iterator[pa.RecordBatch]):
        for batch in slices(batches, "text"):
            data, off = utf8(batch.column("text"))
            wanted = batch.column("wanted")
            counts = np.diff(np.asarray(wanted.offsets))
            flat = wanted.flatten()
            a, o1, o2, c, p = (flat.field(k).to_numpy() for k in ("a", "o1", "o2", "c", "p"))
            at = np.repeat(off[:-1], counts) + p
            lo, hi = at - o1, at - o2 + length
            raw = data.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(o1), pa.array(o2), pa.array(c),
                                              pa.array([raw[x:y] for x, y in zip(lo.tolist(), hi.tolist())], pa.binary())], [*_CONTEXT, "piece"])
    return fn


_MARKED = pa.schema([("a", pa.int64()), ("o1", pa.int32()), ("o2", pa.int32()), ("c", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])


def _runs_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def _shard(length: int):
    def fn(group: pa.Table) -> pa.Table:
        pieces = group.column("piece").to_pylist()
        found = [_runs_of(m) for m in repeated_starts(pieces, length)]
        counts = [len(lo) for lo, _ in found]
        row = np.repeat(np.arange(len(pieces)), counts)
        keys = [group.column(k).to_numpy()[row] for k in _CONTEXT]
        spans = [np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in (0, 1)]
        return pa.table([pa.array(x, f.type) for x, f in zip([*keys, *spans], _MARKED)], schema=_MARKED)
    return fn


def _window_rows(length: int):
    def fn(batches: Iterator[pa.RecordBatch]):
        for batch in slices(batches, "piece", 1 << 16):
            data, off = utf8(batch.column("piece"))
            sums = prefix_hash(data)
            wide = np.maximum(np.diff(off) - length + 1, 0)
            inside = np.arange(int(wide.sum())) - np.repeat(np.cumsum(wide) - wide, wide)
            at = np.repeat(off[:-1], wide) + inside
            h = (sums[at + length] - sums[at]) * inverse_powers(len(sums))[at]
            row = np.repeat(np.arange(len(wide)), wide)
            yield pa.RecordBatch.from_arrays([pa.array(batch.column(k).to_numpy()[row]) for k in _CONTEXT] + [
                pa.array(inside, pa.int32()), pa.array(mix64(h).view(np.int64)), pa.array(mix64(h ^ np.uint64(0x77)).view(np.int64))], [*_CONTEXT, "at", "w1", "w2"])
    return fn


def _core_rows(length: int):
    """Every context cut around each core in it: windows that start 0 to ``CORE_STEP`` bytes before the core."""
    def fn(batches: Iterator[pa.RecordBatch]):
        for batch in slices(batches, "piece", 1 << 18):
            data, off = utf8(batch.column("piece"))
            sums, back = prefix_hash(data), inverse_powers(len(data) + 1)
            before, last = (batch.column(k).to_numpy().astype(np.int64) for k in ("o1", "o2"))
            last = before - last
            out: list[list[np.ndarray]] = [[], [], [], [], []]
            for i in range((length - ANCHOR) // CORE_STEP + 2):
                core = before - i * CORE_STEP  # a window from s needs this core when s is in [core - CORE_STEP, core]
                lo, hi = np.maximum(0, core - CORE_STEP), np.minimum(last, core)
                at = np.flatnonzero(lo <= hi)
                x, y, z = off[at] + lo[at], off[at] + hi[at] + length, off[at] + core[at]
                h = (sums[z + length - CORE_STEP] - sums[z]) * back[z]
                whole = (sums[y] - sums[x]) * back[x]
                for column, value in zip(out, (at, lo[at], mix64(h ^ np.uint64(i)).view(np.int64), mix64(whole ^ (y - x).astype(np.uint64)).view(np.int64), np.stack([x, y], 1))):
                    column.append(value)
            row, lo, core, d, cut = (np.concatenate(c) for c in out)
            raw = data.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(batch.column(k).to_numpy()[row]) for k in _CONTEXT] + [
                pa.array(lo, pa.int32()), pa.array(core), pa.array(d), pa.array([raw[x:y] for x, y in cut.tolist()], pa.binary())], [*_CONTEXT, "at", "core", "d", "part"])
    return fn


_MARK_SCHEMA = "a long, o1 int, o2 int, c long, lo int, hi int"


def _by_shards(pieces: DataFrame, length: int, shard_bytes: int) -> DataFrame:
    """Marked windows of contexts, shard by shard; equal ``a`` stay together."""
    total = pieces.agg(F.sum(F.length("piece") + 1).alias("b")).first()["b"] or 0
    shards = max(1, -(-total // shard_bytes))
    return pieces.withColumn("shard", F.pmod(F.xxhash64("a"), F.lit(shards))).groupBy("shard").applyInArrow(_shard(length), _MARK_SCHEMA)


def _crowded_marks(contexts: DataFrame, length: int, shard_bytes: int, crowded: int) -> DataFrame:
    """The same for crowded anchors, by cores; equal cuts collapse first, with map-side sums."""
    cuts = stored(contexts.select(*_CONTEXT, "piece").mapInArrow(
        _core_rows(length), "a long, o1 int, o2 int, c long, at int, core long, d long, part binary"), "repeat-cuts")
    distinct = cuts.groupBy(F.col("core").alias("a"), F.col("d").alias("c")).agg(F.count(F.lit(1)).alias("n"), F.first("part").alias("piece"))
    distinct = stored(distinct.select("a", F.lit(0).alias("o1"), F.lit(0).alias("o2"), "c", "n", "piece"), "repeat-cores")
    sizes = distinct.groupBy("a").agg(F.count(F.lit(1)).alias("contexts")).filter("contexts > 1")
    shared = stored(distinct.join(sizes, "a"), "repeat-shared-cores")
    windows = stored(shared.filter(F.col("contexts") > crowded).select(*_CONTEXT, "piece").mapInArrow(
        _window_rows(length), "a long, o1 int, o2 int, c long, at int, w1 long, w2 long"), "repeat-windows")
    twice = windows.groupBy("a", "w1", "w2").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").drop("k")
    marks = (distinct.filter("n > 1").select("a", "c", F.lit(0).alias("lo"), (F.length("piece") - length).alias("hi"))
             .unionByName(_by_shards(shared.filter(F.col("contexts") <= crowded), length, shard_bytes).select("a", "c", "lo", "hi"))
             .unionByName(windows.join(twice, ["a", "w1", "w2"], "left_semi").select("a", "c", F.col("at").alias("lo"), F.col("at").alias("hi"))))
    marks = marks.select(F.col("a").alias("core"), F.col("c").alias("d"), "lo", "hi")
    return cuts.drop("part").join(marks, ["core", "d"]).select(*_CONTEXT, (F.col("at") + F.col("lo")).alias("lo"), (F.col("at") + F.col("hi")).alias("hi"))


def _cut(length: int, with_text: bool):
    def fn(batches: Iterator[pa.RecordBatch]):
        for batch in slices(batches, "text"):
            data, off = utf8(batch.column("text"))
            spans = batch.column("spans")
            ends = np.asarray(spans.offsets)
            flat = spans.flatten()
            lo, hi = flat.field("lo").to_numpy(), flat.field("hi").to_numpy()
            none = spans.is_null().to_numpy(zero_copy_only=False)
            copies = batch.column("copies").to_numpy()
            out: list[list] = [[], [], [], [], [], []]
            for i in range(batch.num_rows):
                text = data[off[i]:off[i + 1]]
                n = len(text)
                if copies[i] > 1 and n >= length:
                    a, b = np.array([0]), np.array([n])
                elif none[i] or ends[i] == ends[i + 1]:
                    a = b = np.zeros(0, np.int64)
                else:
                    x, y = lo[ends[i] - ends[0]:ends[i + 1] - ends[0]], hi[ends[i] - ends[0]:ends[i + 1] - ends[0]]
                    order = np.argsort(x, kind="stable")
                    x, y = x[order], np.maximum.accumulate(y[order])
                    new = np.ones(len(x), bool)
                    new[1:] = x[1:] > y[:-1]
                    a, b = x[new], y[np.append(np.flatnonzero(new)[1:], len(x)) - 1]
                mask = np.ones(n, bool)
                for s, e in zip(a.tolist(), b.tolist()):
                    mask[s:e] = False
                kept = text[mask].tobytes() if len(a) else text.tobytes()
                for column, value in zip(out, (n, n - len(kept), len(a), hashlib.sha256(kept).hexdigest(), kept if with_text else None,
                                               [{"start": int(s), "end": int(e)} for s, e in zip(a, b)] if with_text else None)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("t1"), batch.column("t2"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()),
                 pa.array(out[3], pa.string()), pa.array(out[4], pa.binary()),
                 pa.array(out[5], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                ["t1", "t2", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"])
    return fn


def remove_repeats(docs: DataFrame, length: int = 200, with_text: bool = True, shard_bytes: int = SHARD_BYTES, crowded: int = CROWDED) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes), spans.

    A byte goes when it is covered by a ``length``-byte string that starts anywhere else too.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    texts = distinct_texts(docs)
    rows = stored(texts.select("t1", "t2", "text").mapInArrow(_anchor_rows(length), _ANCHOR_SCHEMA), "repeat-anchors")
    ordered = rows.repartitionByRange(*_ANCHOR_FIELDS).sortWithinPartitions(*_ANCHOR_FIELDS)
    shared = stored(ordered.mapInArrow(_shared, _ANCHOR_SCHEMA + ", run long"), "repeat-shared")
    heads = shared.filter("run > 0").groupBy(*_CONTEXT).agg(F.sum("run").alias("n"), F.min(F.struct("t1", "t2", "p")).alias("place"))
    heads = stored(heads, "repeat-contexts")
    many = heads.groupBy("a").agg(F.count(F.lit(1)).alias("contexts")).filter("contexts > 1")
    wanted = heads.join(many, "a").groupBy("place.t1", "place.t2").agg(F.collect_list(F.struct(*_CONTEXT, F.col("place.p").alias("p"))).alias("wanted"))
    pieces = stored(texts.join(wanted, ["t1", "t2"]).select("text", "wanted").mapInArrow(
        _contexts(length), "a long, o1 int, o2 int, c long, piece binary").join(many, "a"), "repeat-pieces")
    marked = _by_shards(pieces.filter(F.col("contexts") <= crowded), length, shard_bytes).unionByName(
        _crowded_marks(pieces.filter(F.col("contexts") > crowded), length, shard_bytes, crowded))
    # Spans: whole contexts that occur twice, marked parts of the others.
    start = F.col("p") - F.col("o1")
    whole = (start.alias("lo"), (F.col("p") - F.col("o2") + length).alias("hi"))
    single = shared.filter("run = 1").join(heads.select(*_CONTEXT, "n"), _CONTEXT)
    parts = single.filter("n = 1").drop("n", "run").join(marked, _CONTEXT)
    spans = (shared.filter("run <> 1").select("t1", "t2", *whole)
             .unionByName(single.filter("n > 1").select("t1", "t2", *whole))
             .unionByName(parts.select("t1", "t2", (start + F.col("lo")).alias("lo"), (start + F.col("hi") + length).alias("hi"))))
    by_text = spans.groupBy("t1", "t2").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    done = stored(texts.join(by_text, ["t1", "t2"], "left").select("t1", "t2", "text", "copies", "spans").mapInArrow(
        _cut(length, with_text), "t1 long, t2 long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, "
        "spans array<struct<start: long, end: long>>"), "repeat-results")
    t1, t2 = text_key()
    return docs.select("doc_id", t1.alias("t1"), t2.alias("t2")).join(done, ["t1", "t2"]).drop("t1", "t2")
