"""Line deduplication by range-partitioned line hashes.

Every line becomes a row (128-bit hash of its key, document, position). The rows are range-partitioned and sorted by
hash, document and position, so that a line which a third of all documents share spreads over many partitions. Each
partition is read as a stream: runs of one hash are decided as soon as they have enough documents, so memory holds at
most ``min_docs`` documents' rows of one run. Runs cut by a partition border send their few undecided rows to a small
second step. The result is no text but a compressed bitmap of dropped lines per document; texts meet it in one join.

Defined cases: a null or empty text is one empty line; keys shorter than ``min_chars`` code points never go; a document
is a distinct (doc_id, text) pair, so repeated rows count once and get the same result; a null doc_id is an id like any
other; an empty table gives an empty result. Columns of other names pass through untouched.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from evalspark.llm.common import LOWER, SPACE, UPPER, hash_pair, slices, stored

DROP, PENDING, MARK = 0, 1, 2
_DECIDED = "kind int, h1 long, h2 long, id long, t1 long, t2 long, pos int"
_FIELDS = ["h1", "h2", "id", "t1", "t2", "pos"]


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def line_rows(docs: DataFrame, min_chars: int) -> DataFrame:
    """One row per line that may go: (h1, h2) of the key, (id, t1, t2) of the document, pos."""
    t1, t2 = hash_pair(F.coalesce("text", F.lit("")))
    lines = docs.select(F.col("doc_id").cast("long").alias("id"), t1.alias("t1"), t2.alias("t2"),
                        F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("pos", "line"))
    lines = lines.select("id", "t1", "t2", "pos", line_key(F.col("line")).alias("key")).filter(F.char_length("key") >= min_chars)
    h1, h2 = hash_pair(F.col("key"))
    return lines.select(h1.alias("h1"), h2.alias("h2"), "id", "t1", "t2", "pos")


def _runs(min_docs: int, keep_first: bool):
    def emit(kind, rows):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), kind, np.int32))] + [c.cast(t) for c, t in zip(
            rows.to_arrays(), [pa.int64()] * 5 + [pa.int32()])], ["kind", *_FIELDS])

    class Rows:
        """Columns of some rows; the nullable id carries a mask."""

        def __init__(self, cols, null):
            self.cols, self.null = cols, null

        def __len__(self):
            return len(self.null)

        def take(self, i):
            return Rows([c[i] for c in self.cols], self.null[i])

        def to_arrays(self):
            return [pa.array(c, mask=self.null) if k == 2 else pa.array(c) for k, c in enumerate(self.cols)]

    def join(a, b):
        return b if a is None else Rows([np.concatenate(p) for p in zip(a.cols, b.cols)], np.concatenate([a.null, b.null]))

    def of(batch):
        null = batch.column("id").is_null().to_numpy(zero_copy_only=False)
        return Rows([(batch.column(f).fill_null(0) if f == "id" else batch.column(f)).to_numpy(zero_copy_only=False) for f in _FIELDS], null)

    def fn(batches: Iterator[pa.RecordBatch]):
        carry, first_key, open_key, previous = None, None, None, None  # open_key: decided run that may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = of(batch)
            again = rows.null.copy()  # repeated input rows lie side by side; one of each is enough
            again[1:] = rows.null[1:] == rows.null[:-1]
            for c in rows.cols:
                again[1:] &= c[1:] == c[:-1]
            now = (*(c[0] for c in rows.cols), rows.null[0])
            again[0] = now == previous
            previous = (*(c[-1] for c in rows.cols), rows.null[-1])
            rows = join(carry, rows.take(np.flatnonzero(~again)))
            carry = None
            if len(rows) == 0:
                continue
            h1, h2 = rows.cols[0], rows.cols[1]
            if first_key is None:
                first_key = (h1[0], h2[0])
            if open_key is not None:  # rows of a run that already has its documents
                same = (h1 == open_key[0]) & (h2 == open_key[1])
                if same.any():
                    yield emit(DROP, rows.take(np.flatnonzero(same)))
                    rows = rows.take(np.flatnonzero(~same))
                    h1, h2 = rows.cols[0], rows.cols[1]
                if len(rows) == 0:
                    continue
                open_key = None
            new = np.ones(len(rows), bool)
            new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            doc = new.copy()
            doc[1:] |= (rows.null[1:] != rows.null[:-1])
            for k in (2, 3, 4):
                doc[1:] |= rows.cols[k][1:] != rows.cols[k][:-1]
            start = np.flatnonzero(new)
            n_docs = np.add.reduceat(doc.astype(np.int64), start)
            enough = n_docs >= min_docs
            run = np.cumsum(new) - 1
            at_first = np.zeros(len(start), bool)
            at_first[0] = (h1[0], h2[0]) == first_key
            last = len(start) - 1
            decided = enough[run]
            head = new.copy()
            edge_head = head & (at_first[run] | (run == last))
            drop = decided & ~edge_head & ~(head if keep_first else np.zeros(len(rows), bool))
            if drop.any():
                yield emit(DROP, rows.take(np.flatnonzero(drop)))
            mark = decided & edge_head
            if mark.any():
                chosen = rows.take(np.flatnonzero(mark))
                yield emit(PENDING, chosen)
                yield emit(MARK, chosen)
            wait = ~decided & at_first[run] & (run != last)
            if wait.any():
                yield emit(PENDING, rows.take(np.flatnonzero(wait)))
            if enough[last]:
                open_key = (h1[-1], h2[-1])
            else:
                carry = rows.take(np.arange(start[last], len(rows)))
        if carry is not None:
            yield emit(PENDING, carry)
    return fn


def dropped_lines(docs: DataFrame, min_chars: int, min_docs: int, keep_first: bool) -> DataFrame:
    """(id, t1, t2, pos) of every line that goes."""
    key = ["h1", "h2", "id", "t1", "t2", "pos"]
    ordered = stored(line_rows(docs, min_chars), "line-rows").repartitionByRange(*key).sortWithinPartitions(*key)
    decided = stored(ordered.mapInArrow(_runs(min_docs, keep_first), _DECIDED), "line-decisions")
    # Borders: at most two runs per partition, each with fewer than min_docs documents or one row and a mark.
    run = Window.partitionBy("h1", "h2")
    place = F.struct(F.col("id").isNotNull(), "id", "t1", "t2", "pos")
    border = (decided.filter(F.col("kind") != DROP)
              .withColumn("marked", F.max(F.col("kind") == MARK).over(run))
              .withColumn("n", F.size(F.collect_set(F.struct("id", "t1", "t2")).over(run)))
              .withColumn("head", F.min(F.when(F.col("kind") == PENDING, place)).over(run))
              .filter((F.col("kind") == PENDING) & (F.col("marked") | (F.col("n") >= min_docs))))
    if keep_first:
        border = border.filter(~place.eqNullSafe(F.col("head")))
    columns = ["id", "t1", "t2", "pos"]
    return decided.filter(F.col("kind") == DROP).select(*columns).unionByName(border.select(*columns))


@F.pandas_udf(T.BinaryType())
def pack_bits(positions: pd.Series) -> pd.Series:
    """Compressed bitmap with the given bits set."""
    def one(p):
        bits = np.zeros(int(p.max()) + 1, np.uint8)
        bits[p] = 1
        return zlib.compress(np.packbits(bits, bitorder="little").tobytes())
    return positions.map(one)


def drop_bitmaps(docs: DataFrame, min_chars: int = 1, min_docs: int = 10, keep_first: bool = False) -> DataFrame:
    """(id, t1, t2, bitmap): zlib-compressed bits of the dropped lines, for documents that lose any."""
    gone = dropped_lines(docs, min_chars, min_docs, keep_first)
    return (gone.groupBy("id", "t1", "t2").agg(F.collect_list("pos").alias("positions"))
            .select("id", "t1", "t2", pack_bits("positions").alias("bitmap")))


_KEPT = T.StructType([T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()),
                      T.StructField("kept_sha256", T.StringType()), T.StructField("changed", T.StringType())])


def _keep(with_text: bool):
    @F.arrow_udf(_KEPT)
    def keep(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for text, bitmap in columns:
            out: list[list] = [[], [], [], []]
            for part in slices(iter([pa.RecordBatch.from_arrays([text, bitmap], ["text", "bitmap"])]), "text"):
                for t, b in zip(part.column("text").to_pylist(), part.column("bitmap").to_pylist()):
                    t = t or ""
                    if b is None:
                        n, k, kept = t.count("\n") + 1, 0, t
                    else:
                        lines = t.split("\n")
                        bits = np.unpackbits(np.frombuffer(zlib.decompress(b), np.uint8), bitorder="little")[:len(lines)]
                        gone = np.zeros(len(lines), bool)
                        gone[:len(bits)] = bits
                        n, k = len(lines), int(gone.sum())
                        kept = "\n".join(x for x, g in zip(lines, gone) if not g)
                    shown = kept if with_text and k else None
                    for column, value in zip(out, (n, k, hashlib.sha256(kept.encode()).hexdigest(), shown)):
                        column.append(value)
            yield pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.string()))],
                                             ["n_lines", "n_dropped", "kept_sha256", "changed"])
    return keep


def dedup_lines(docs: DataFrame, min_chars: int = 1, min_docs: int = 10, keep_first: bool = False, with_text: bool = True) -> DataFrame:
    """Columns ``row`` (the input row as a struct) and ``out`` (n_lines, n_dropped, kept_sha256, and ``changed``: the kept text of a document that lost lines).

    A line goes from every document (or, with ``keep_first``, from all but its first document) when its key occurs in
    ``min_docs`` documents or more.
    """
    bitmaps = drop_bitmaps(docs.select("doc_id", "text"), min_chars, min_docs, keep_first)
    t1, t2 = hash_pair(F.coalesce("text", F.lit("")))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc"), t1.alias("x1"), t2.alias("x2"))
    joined = rows.join(bitmaps, F.col("doc").eqNullSafe(F.col("id")) & (F.col("x1") == F.col("t1")) & (F.col("x2") == F.col("t2")), "left")
    return joined.select("row", _keep(with_text)(F.col("row.text"), F.col("bitmap")).alias("out"))
