"""Best-fit packing of token sequences with certified bin counts.

Documents are tokenized where they are read; only lengths and checksums leave that stage. Pieces are dealt by hash to
partitions of bounded size, each packed by best fit decreasing. A dual feasible function bound certifies a partition
whose bin count equals it. As long as the whole corpus has a gap to its bound, all partitions give up their emptiest bins
(more where their own bound shows a gap), and the documents in them are dealt anew and packed together; a group of bins is
replaced only when it takes fewer. Bins settled in one turn take part in the next; a turn that saves no bin is the last.

Defined cases: a null or empty text is one end token; repeated rows are packed once each, whatever partition they are dealt
to; an empty table gives no rows.
"""

from __future__ import annotations

import math
import os
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evalspark.llm.common import slices, stored

CAPACITY = 2048
GROUP_ROWS = 20_000
CACHE_WORDS = 250_000
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_TOKENIZERS: dict[str, "WordCache"] = {}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


# The pieces that the vocabulary's pattern cuts, for lower-case ASCII words, and its byte alphabet.
ASCII_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_ALPHABET = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in SHOWN)}


class WordCache(dict):
    """Ids of a text as little-endian 32-bit bytes.

    The vocabulary drops white space and never joins ids across it, so words are encoded once and looked up afterwards.
    When the cache holds ``CACHE_WORDS`` words it becomes the older of two, from which words still in use are taken over; the
    one before goes. Texts whose normal form could cross white space, and texts that may hold an added token (such as
    ``<|endoftext|>``, one id as the tokenizer is loaded), go through it whole.
    """

    ODD = frozenset("\x1c\x1d\x1e\x1fΣİ")

    def __init__(self, path: str):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model
        self.heads = {t.content[:2].lower() for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.older: dict[str, bytes] = {}
        self.packed = [struct.pack("<I", i) for i in range(self.tokenizer.get_vocab_size())]

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def piece(self, text: str) -> bytes:
        """Ids of a piece that the pattern does not cut further: only the merges are left to do."""
        if not (text.isascii() and text.isprintable()):
            text = text.encode().decode("latin-1").translate(BYTE_ALPHABET)
        return b"".join([self.packed[t.id] for t in self.merges.tokenize(text)])

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.older = dict(self)
            self.clear()
        ids = self.older.get(word)
        if ids is None:
            if word.isalpha() and (word.isascii() or max(word) < "\u0250" and word.islower()):  # one run of letters
                ids = self.piece(word)
            elif len(word) > 1 and word[-1] in ".,;:!?|" and word[-2].isalnum():  # such a mark is a token of its own
                ids = self[word[:-1]] + self[word[-1]]
            elif word.isascii() and word.lower() == word:
                pieces = ASCII_PIECES.findall(word)
                ids = self.piece(word) if len(pieces) == 1 else b"".join(map(self.__getitem__, pieces))
            else:
                ids = self.whole(word)
        self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if not self.ODD.isdisjoint(text) or not unicodedata.is_normalized("NFC", text):
            return self.whole(text)
        low = text.lower()
        if any(head in low for head in self.heads):
            return self.whole(text)
        return b"".join(map(self.__getitem__, low.split()))


def _tokenize(path: str, capacity: int, end_id: int):
    tail = np.array([end_id], "<u4").tobytes()

    def fn(batches: Iterator[pa.RecordBatch]):
        if path not in _TOKENIZERS:
            _TOKENIZERS[path] = WordCache(path)
        cache = _TOKENIZERS[path]
        for batch in slices(batches, "text"):
            out: list[list] = [[], [], [], [], []]
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = cache.encode(text or "") + tail
                n = len(ids) // 4
                for piece, start in enumerate(range(0, n, capacity)):
                    part = ids[4 * start: 4 * (start + capacity)]
                    for column, value in zip(out, (doc, piece, start, len(part) // 4, zlib.crc32(part))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                                             ["doc_id", "piece", "start", "length", "ids_crc32"])
    return fn


def tokenize(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """One row per piece; a document of more than ``capacity`` ids (end token included) is cut into full pieces and a rest."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return rows.mapInArrow(_tokenize(path or tokenizer_path(), capacity, end_id), _PIECES)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every length, which must come in falling order. ``free`` has a bit per room some open bin has."""
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    free, bins = 0, 0
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, size in enumerate(lengths.tolist()):
        fits = free >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                free ^= 1 << room
        else:
            room, b = capacity, bins
            bins += 1
        where[i], offset[i] = b, capacity - room
        left = room - size
        if left:
            if not rooms[left]:
                free |= 1 << left
            rooms[left].append(b)
    return where, offset


def least_bins(counts: np.ndarray, capacity: int) -> int:
    """Lower bound from dual feasible functions: lengths above capacity - t count whole, those below t not at all.

    ``counts[s]`` is the number of lengths s; the bound is the largest over all t from 0 to half the capacity.
    """
    sizes = np.arange(capacity + 1)
    total, number = np.cumsum(counts * sizes), np.cumsum(counts)
    half = capacity // 2
    t = np.arange(0, half + 1)
    large = number[capacity] - number[capacity - t]
    middle = number[capacity - t] - number[half]
    middle_sum = total[capacity - t] - total[half]
    small_sum = total[half] - np.where(t > 0, total[np.maximum(t - 1, 0)], 0)
    extra = np.ceil(np.maximum(0, small_sum - (middle * capacity - middle_sum)) / capacity)
    return int(np.max(large + middle + extra, initial=0))


_PACKED = _PIECES + ", part long, bin long, offset long, fill long, gap int"


def _pack(capacity: int):
    def fn(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "piece", "start", "ids_crc32"], ascending=[False, True, True, True, True], kind="stable")
        lengths = group["length"].to_numpy()
        where, offset = best_fit_decreasing(lengths, capacity)
        fill = np.bincount(where, weights=lengths)
        bound = least_bins(np.bincount(lengths, minlength=capacity + 1)[:capacity + 1], capacity)
        return group.assign(bin=where, offset=offset, fill=fill[where].astype(np.int64), gap=len(fill) - bound)[
            ["doc_id", "piece", "start", "length", "ids_crc32", "part", "bin", "offset", "fill", "gap"]]
    return fn


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Adds sequence_id and offset to stored pieces of 1 to ``capacity`` ids.

    Driver memory: one number per call (rows, bins); histograms have ``capacity`` entries.
    """
    n = pieces.count()
    groups = max(1, math.ceil(n / group_rows))
    # The row's place in the stored table spreads equal rows.
    deal = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups))
    packed = stored(pieces.withColumn("part", deal).groupBy("part").applyInPandas(_pack(capacity), _PACKED), "packed")
    if n == 0:
        return packed.select(*_names(), F.lit(0).cast("long").alias("sequence_id"), "offset")
    sizes = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()
    counts = np.zeros(capacity + 1, np.int64)
    for r in sizes:
        counts[r["length"]] = r["n"]
    bound = least_bins(counts, capacity)
    total, turn = packed.filter(F.col("offset") == 0).count(), 0
    while total > bound:
        # The emptiest bins of each partition: one, and four more for each bin above the partition's own bound.
        bins = packed.filter((F.col("offset") == 0) & (F.col("fill") < capacity))
        give = bins.withColumn("r", F.row_number().over(_emptiest())).filter(F.col("r") <= 1 + 4 * F.col("gap")).select("part", "bin")
        marked = packed.join(give.withColumn("give", F.lit(True)), ["part", "bin"], "left")
        pool = stored(marked.filter(F.col("give")).drop("give"), "exchanged")
        rest = marked.filter(F.col("give").isNull()).drop("give")
        dealt = max(1, math.ceil(pool.count() / group_rows))
        mixed = pool.withColumn("old", F.struct("part", "bin")).withColumn("part", -1 - F.pmod(F.xxhash64("part", "bin", F.lit(turn)), F.lit(dealt)) - F.lit(turn << 24))
        before = mixed.filter(F.col("offset") == 0).groupBy("part").agg(F.count(F.lit(1)).alias("before"))
        again = stored(mixed.select(*_names(), "part").groupBy("part").applyInPandas(_pack(capacity), _PACKED), "repacked")
        after = again.filter(F.col("offset") == 0).groupBy("part").agg(F.count(F.lit(1)).alias("after"))
        better = stored(before.join(after, "part").filter(F.col("after") < F.col("before")).select(F.col("part").alias("ok"), (F.col("before") - F.col("after")).alias("saved")), "better")
        saved = better.agg(F.sum("saved")).first()[0] or 0
        if not saved:
            break
        kept = mixed.join(better, F.col("part") == F.col("ok"), "left_anti").select(
            *_names(), F.col("old.part").alias("part"), F.col("old.bin").alias("bin"), "offset", "fill", F.lit(0).alias("gap"))
        fresh = again.join(better, F.col("part") == F.col("ok"), "left_semi")
        packed = stored(rest.select(*packed.columns).unionByName(kept.select(*packed.columns)).unionByName(fresh.select(*packed.columns)), "packed")
        total, turn = total - saved, turn + 1
    return packed.select(*_names(), (F.col("part") * F.lit(1 << 20) + F.col("bin")).alias("sequence_id"), "offset")


def _names() -> list[str]:
    return ["doc_id", "piece", "start", "length", "ids_crc32"]


def _emptiest():
    return Window.partitionBy("part").orderBy("fill", "bin")


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    return pack(stored(tokenize(docs, path, capacity), "pieces"), capacity, group_rows)
