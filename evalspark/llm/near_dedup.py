"""Near-duplicate documents by a chosen-path set similarity join over word shingles.

1. Every text becomes the set of its distinct word shingles (hashed to 64 bits), a 128-bit key of that set and 64 minwise
   tokens. Documents with equal sets are one class from here on, however many there are.
2. Chosen paths: each independent tree starts at a root node; a node passes a class on to ``BRANCH`` children, each named
   by one of its minwise positions (chosen by a hash of the node, the same for all classes there) and the class's token at it. Nodes
   with up to ``NODE_LIMIT`` classes are compared exhaustively; larger ones branch again, down to ``DEPTH`` levels.
   A pair of similarity s survives a level with probability 1 - (1 - s q)**BRANCH, q being that of the levels below; trees
   are repeated until the chance to miss a pair at the threshold is below 1 - ``recall``.
3. Comparing a node gives groups, not pairs: classes joined by chains of pairs that agree on enough of the 64 tokens (five
   standard deviations wide). A group is named by its members, so the same group found in many nodes is confirmed once.
4. Nodes still crowded at the last level are checked against their centre (the class nearest to the commonest token of each
   position). A node that is one linked component then is done; in others the classes outside the centre's component meet
   all classes of the node, as one group.
5. Groups are confirmed on full sets, in blocks of bounded size: each pair of blocks works out all its exact similarities
   and returns links that join what its linked pairs join, at most one per class. So no step returns all pairs of a group.

Defined cases: texts without words (null, empty, blank) have size 0 and are linked with nothing; texts with fewer words
than a shingle are one shingle of all their words; rows sharing a doc_id are separate texts of that id; a null doc_id never
names a component unless no member has an id. Other columns pass through untouched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import SPACE, give_back, mix64, slices, stored, utf8, words
from evalspark.llm.components import components

TOKENS = 64
BRANCH = 2
NODE_LIMIT = 2048
DEPTH = 3
RECALL = 0.9999
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 1 << 19  # a task then works out a million similarities of half a million shingles a side
OFTEN = 64  # shingles in more sets of a block than this are multiplied as matrix columns
_MULTIPLIERS = mix64(np.arange(1, TOKENS + 1, dtype=np.uint64)) | np.uint64(1)
_ADDENDS = mix64(np.arange(1001, TOKENS + 1001, dtype=np.uint64))
_STEP = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
                  0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def shingles(data: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word shingles, text after text, and their number per text (one for a text with fewer words)."""
    w, n = words(data, off)
    starts = np.cumsum(n) - n
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    ends = np.cumsum(count)
    at = np.repeat(starts, count) + np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - count, count)
    length = np.repeat(np.minimum(n, size), count).astype(np.uint64)
    h = mix64(length)
    padded = np.append(w, np.zeros(size, np.uint64))
    for j in range(size):
        more = length > np.uint64(j)
        h = np.where(more, mix64(h ^ (padded[at + j] * _STEP[j % len(_STEP)] + np.uint64(j))), h)
    return h, count


def sets(data: np.ndarray, off: np.ndarray, size: int):
    """Sorted distinct shingles of every text, with bounds; a 128-bit key of each set."""
    h, count = shingles(data, off, size)
    ends = np.cumsum(count)
    parts = [np.unique(h[a:b]) for a, b in zip(ends - count, ends)]
    n = np.array([len(p) for p in parts], np.int64)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    bounds = np.concatenate([[0], np.cumsum(n)])
    s1, s2 = (np.concatenate([[np.uint64(0)], np.cumsum(x)]) for x in (mix64(flat ^ np.uint64(0x51)), mix64(flat ^ np.uint64(0xA7))))
    k1, k2 = (mix64(s[bounds[1:]] - s[bounds[:-1]] + n.astype(np.uint64)).view(np.int64) for s in (s1, s2))
    return flat, bounds, n, k1, k2


def minwise(flat: np.ndarray, bounds: np.ndarray, n: np.ndarray) -> np.ndarray:
    out = np.zeros((len(n), TOKENS), np.uint32)
    full = np.flatnonzero(n)
    if len(full):
        cuts = bounds[:-1][full]
        for j in range(TOKENS):
            out[full, j] = np.minimum.reduceat((flat * _MULTIPLIERS[j] + _ADDENDS[j]) >> np.uint64(32), cuts).astype(np.uint32)
    return out


def _features(size: int):
    def fn(batches: Iterator[pa.RecordBatch]):
        for batch in slices(batches, "text"):
            flat, bounds, n, k1, k2 = sets(*utf8(batch.column("text")), size)
            tokens = minwise(flat, bounds, n).view(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("h"), pa.array(n), pa.array(k1), pa.array(k2),
                 pa.FixedSizeListArray.from_arrays(pa.array(tokens.ravel()), TOKENS).cast(pa.list_(pa.int32()))],
                ["doc_id", "h", "n", "k1", "k2", "tokens"])
    return fn


def features(docs: DataFrame, size: int) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    return rows.mapInArrow(_features(size), "doc_id long, h long, n long, k1 long, k2 long, tokens array<int>")


def trees_for(recall: float, threshold: float, depth: int = DEPTH, branch: int = BRANCH) -> int:
    keep = 1.0
    for _ in range(depth):
        keep = 1 - (1 - threshold * keep) ** branch
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - keep)))


def _children(node, j_count: int = BRANCH):
    """Child nodes of a class at ``node``: position chosen by the node, token by the class."""
    first = F.pmod(F.xxhash64(node, F.lit(11)), F.lit(TOKENS)).cast("int")
    places = [first] + [F.pmod(first + 1 + F.pmod(F.xxhash64(node, F.lit(11 + j)), F.lit(TOKENS - 1)).cast("int"), F.lit(TOKENS)) for j in range(1, j_count)]
    return F.array(*[F.xxhash64(node, p, F.element_at("tokens", p + 1)) for p in places])


def _least_agreeing(threshold: float) -> int:
    """Agreeing tokens below this are five standard deviations short of the threshold."""
    return max(1, math.floor(TOKENS * threshold - 5 * math.sqrt(TOKENS * threshold * (1 - threshold))))


_GROUP = "gid long, k1 long, k2 long"


def _joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of the component of each of ``n`` places, under the pairs (a, b)."""
    label = np.arange(n)
    while len(a):
        new = label.copy()
        np.minimum.at(new, b, label[a])
        np.minimum.at(new, a, label[b])
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def _agreeing_groups(k1, k2, tokens, least: int) -> pa.RecordBatch:
    """Classes of one node that chains of agreeing pairs join, each group under a name made of its members."""
    left, right = [], []
    for i in range(len(k1) - 1):
        j = np.flatnonzero((tokens[i + 1:] == tokens[i]).sum(axis=1) >= least) + i + 1
        left.append(np.full(len(j), i))
        right.append(j)
    label = _joined(len(k1), np.concatenate(left), np.concatenate(right)) if left else np.arange(len(k1))
    own = mix64(k1.view(np.uint64) ^ mix64(k2.view(np.uint64)))
    name, size = np.zeros(len(k1), np.uint64), np.bincount(label, minlength=len(k1))
    np.add.at(name, label, own)
    keep = np.flatnonzero(size[label] > 1)
    gid = mix64(name[label[keep]] + size[label[keep]].astype(np.uint64))
    return pa.RecordBatch.from_arrays([pa.array(gid.view(np.int64)), pa.array(k1[keep]), pa.array(k2[keep])], ["gid", "k1", "k2"])


def _token_matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), TOKENS)


def _node_runs(least: int):
    """Rows sorted by node; finds the groups of each node as it passes."""
    def fn(batches: Iterator[pa.RecordBatch]):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = (batch.column("node").to_numpy(), batch.column("k1").to_numpy(), batch.column("k2").to_numpy(), _token_matrix(batch.column("tokens")))
            if held is not None:
                now = tuple(np.concatenate(p) for p in zip(held, now))
            bounds = np.concatenate([[0], np.flatnonzero(now[0][1:] != now[0][:-1]) + 1])
            for a, b in zip(bounds[:-1], bounds[1:]):
                yield _agreeing_groups(now[1][a:b], now[2][a:b], now[3][a:b], least)
            held = tuple(x[bounds[-1]:] for x in now)
        if held is not None:
            yield _agreeing_groups(*held[1:], least)
        give_back()
    return fn


def _consensus(group: pa.Table) -> pa.Table:
    tokens = _token_matrix(group.column("tokens").combine_chunks())
    common = []
    for j in range(TOKENS):
        values, counts = np.unique(tokens[:, j], return_counts=True)
        common.append(int(values[counts.argmax()]))
    return pa.table([pa.array([group.column("node")[0].as_py()]), pa.array([common], pa.list_(pa.int32()))], ["node", "common"])


def _agreeing(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """[i, j]: number of shingles that sets left[i] and right[j] share. Rare shingles meet one by one, common ones as matrix columns."""
    out = np.zeros((len(left), len(right)), np.int32)
    if not left or not right:
        return out
    flat = np.concatenate(left + right)
    side = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in left + right])
    cut = sum(map(len, left))
    _, shingle = np.unique(flat, return_inverse=True)
    in_left, in_right = (np.bincount(shingle[part], minlength=int(shingle.max()) + 1 if len(shingle) else 0) for part in (slice(None, cut), slice(cut, None)))
    both = (in_left > 0) & (in_right > 0)
    often = both & (np.maximum(in_left, in_right) > OFTEN)
    rows_l, cols_l, rows_r, cols_r = side[:cut], shingle[:cut], side[cut:] - len(left), shingle[cut:]
    # Rare: every place on the left lists the places on the right that hold the same shingle.
    rare = both & ~often
    keep = rare[cols_r]
    order = np.argsort(cols_r[keep], kind="stable")
    held, held_by = cols_r[keep][order], rows_r[keep][order]
    asks = np.flatnonzero(rare[cols_l])
    for i in range(0, len(asks), 1 << 16):
        at = asks[i:i + (1 << 16)]
        lo, n = np.searchsorted(held, cols_l[at]), in_right[cols_l[at]]
        place = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        pair = np.repeat(rows_l[at], n) * len(right) + held_by[place]
        out += np.bincount(pair, minlength=out.size).reshape(out.shape).astype(np.int32)
    columns = np.cumsum(often) - 1
    total = int(often.sum())
    keep_l, keep_r = often[cols_l], often[cols_r]
    rows_l, cols_l, rows_r, cols_r = rows_l[keep_l], columns[cols_l[keep_l]], rows_r[keep_r], columns[cols_r[keep_r]]
    for i in range(0, total, 2048):
        a, b = (np.zeros((n, min(2048, total - i)), np.float32) for n in out.shape)
        for m, rows, cols in ((a, rows_l, cols_l), (b, rows_r, cols_r)):
            here = (cols >= i) & (cols < i + 2048)
            m[rows[here], cols[here] - i] = 1
        out += (a @ b.T).astype(np.int32)
    return out


def _block_links(percent: int):
    """Links that join what the linked pairs of one pair of blocks join; without a second block, all pairs within the first."""
    def fn(group: pa.Table) -> pa.Table:
        second = np.array(group.column("second").to_pylist(), bool)
        k1, k2 = (group.column(c).to_numpy() for c in ("k1", "k2"))
        sets = [np.frombuffer(x, np.uint64) for x in group.column("shingles").to_pylist()]
        one = np.flatnonzero(~second)
        two = np.flatnonzero(second) if second.any() else one
        n = np.array([len(x) for x in sets], np.int64)
        both = intersections([sets[i] for i in one], [sets[i] for i in two])
        i, j = np.nonzero((100 + percent) * both.astype(np.int64) >= percent * (n[one][:, None] + n[two][None, :]))
        # Places stand for classes: one that lies in both blocks is one place.
        _, place = np.unique(np.rec.fromarrays([k1, k2]), return_inverse=True)
        first = np.full(int(place.max()) + 1 if len(place) else 0, -1)
        first[place[::-1]] = np.arange(len(place))[::-1]
        label = _joined(len(first), place[one[i]], place[two[j]])
        moved = np.flatnonzero(label != np.arange(len(label)))
        a, b = first[label[moved]], first[moved]
        give_back()
        return pa.table([pa.array(k1[a]), pa.array(k2[a]), pa.array(k1[b]), pa.array(k2[b])], ["a1", "a2", "b1", "b2"])
    return fn


def _set_rows(size: int):
    def fn(batches: Iterator[pa.RecordBatch]):
        for batch in slices(batches, "text"):
            flat, bounds, n, k1, k2 = sets(*utf8(batch.column("text")), size)
            same = (k1 == batch.column("k1").to_numpy()) & (k2 == batch.column("k2").to_numpy())
            at = np.flatnonzero(same)
            yield pa.RecordBatch.from_arrays(
                [pa.array(k1[at]), pa.array(k2[at]), pa.array([flat[bounds[i]:bounds[i + 1]].tobytes() for i in at], pa.binary())], ["k1", "k2", "shingles"])
    return fn


def _confirm(percent: int):
    @F.pandas_udf("boolean")
    def linked(a: pd.Series, b: pd.Series) -> pd.Series:
        out = np.zeros(len(a), bool)
        for i, (x, y) in enumerate(zip(a, b)):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            if min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)):
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                out[i] = 100 * both >= percent * (len(x) + len(y) - both)
        return pd.Series(out)
    return linked


def _keyed(one: str, two: str):
    return F.struct(F.col(one).alias("k1"), F.col(two).alias("k2"))


class ChosenPathJoin:
    """The join over one table of documents; ``members`` and ``classes`` are stored tables."""

    def __init__(self, docs: DataFrame, size: int, percent: int, recall: float = RECALL, node_limit: int = NODE_LIMIT, depth: int = DEPTH,
                 block_rows: int = BLOCK_ROWS, block_shingles: int = BLOCK_SHINGLES):
        self.docs, self.size, self.percent, self.node_limit, self.depth = docs.select("doc_id", "text"), size, percent, node_limit, depth
        self.block_rows, self.block_shingles = block_rows, block_shingles
        self.least = _least_agreeing(percent / 100)
        self.trees = trees_for(recall, percent / 100, depth)
        self.members = stored(features(docs, size), "near-features")
        filled = self.members.filter("n > 0")
        self.classes = stored(filled.groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id"), F.min(F.struct("doc_id", "h")).alias("example"), F.min("n").alias("n"),
                                                              F.first("tokens").alias("tokens")), "near-classes")

    def groups(self) -> DataFrame:
        """(gid, k1, k2), distinct: classes to be confirmed together. Also sets ``crowded`` (node, k1, k2, tokens)."""
        roots = F.explode(F.sequence(F.lit(0), F.lit(self.trees - 1)))
        rows = self.classes.select("k1", "k2", "tokens", roots.alias("tree")).withColumn("node", F.xxhash64("tree"))
        found = []
        for _ in range(self.depth):
            rows = stored(rows.select("k1", "k2", F.explode(_children(F.col("node"))).alias("node")), "near-nodes")
            counts = rows.groupBy("node").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
            shared = stored(rows.join(counts, "node").join(self.classes.select("k1", "k2", "tokens"), ["k1", "k2"]), "near-shared")
            small = shared.filter(F.col("c") <= self.node_limit).select("node", "k1", "k2", "tokens")
            found.append(small.repartition("node").sortWithinPartitions("node").mapInArrow(_node_runs(self.least), _GROUP))
            rows = shared.filter(F.col("c") > self.node_limit).select("node", "k1", "k2", "tokens")
            if not rows.limit(1).count():
                break
        self.crowded = rows
        out = found[0]
        for more in found[1:]:
            out = out.unionByName(more)
        return stored(out.distinct(), "near-groups")

    def centred(self) -> DataFrame:
        """(node, k1, k2, c1, c2): every class of a crowded node with the node's centre."""
        drawn = self.crowded.withColumn("draw", F.xxhash64("k1", "k2", "node"))
        sizes = self.crowded.groupBy("node").agg(F.count(F.lit(1)).alias("c"))
        sample = drawn.join(sizes, "node").filter(F.pmod("draw", F.col("c")) < 256)  # about 256 of each node
        common = sample.select("node", "tokens").groupBy("node").applyInArrow(_consensus, "node long, common array<int>")
        scored = self.crowded.join(common, "node").withColumn("near", _agreeing("tokens", "common"))
        centre = scored.groupBy("node").agg(F.max(F.struct("near", "k1", "k2")).alias("m"))
        return self.crowded.join(centre.select("node", F.col("m.k1").alias("c1"), F.col("m.k2").alias("c2")), "node").select("node", "k1", "k2", "c1", "c2")

    def shingle_sets(self, keys: DataFrame) -> DataFrame:
        """(k1, k2, shingles) of the wanted classes, from one text of each; the text's hash goes with its id, which may be null or repeated."""
        wanted = keys.join(self.classes.select("k1", "k2", "example"), ["k1", "k2"])
        rows = self.docs.withColumn("h", F.xxhash64("text"))
        same = (rows["h"] == wanted["example.h"]) & rows["doc_id"].cast("long").eqNullSafe(wanted["example.doc_id"])
        texts = rows.join(wanted, same).select("k1", "k2", "text")
        return texts.mapInArrow(_set_rows(self.size), "k1 long, k2 long, shingles binary").dropDuplicates(["k1", "k2"])

    def confirm(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a1, a2, b1, b2) whose full sets are similar enough, as (a, b) of class keys."""
        left = self.sets.select(F.col("k1").alias("a1"), F.col("k2").alias("a2"), F.col("shingles").alias("sa"))
        right = self.sets.select(F.col("k1").alias("b1"), F.col("k2").alias("b2"), F.col("shingles").alias("sb"))
        both = pairs.select("a1", "a2", "b1", "b2").join(left, ["a1", "a2"]).join(right, ["b1", "b2"])
        return both.filter(_confirm(self.percent)("sa", "sb")).select(_keyed("a1", "a2").alias("a"), _keyed("b1", "b2").alias("b"))

    def group_links(self, groups: DataFrame) -> DataFrame:
        """(a, b): links of groups (gid, k1, k2, lead); in each group its leading classes meet all classes."""
        sized = groups.join(self.classes.select("k1", "k2", "n"), ["k1", "k2"])
        blocks = lambda rows, shingles: F.greatest(F.ceil(rows / self.block_rows), F.ceil(shingles / self.block_shingles), F.lit(1)).cast("int")
        led = F.when(F.col("lead"), F.col("n")).otherwise(0)
        cuts = sized.groupBy("gid").agg(blocks(F.count(F.lit(1)), F.sum("n")).alias("all"), blocks(F.sum(F.col("lead").cast("long")), F.sum(led)).alias("leads"))
        dealt = sized.join(cuts, "gid")  # "whole": all lead, so a single block holds its pairs
        draw = lambda c: F.pmod(F.xxhash64("k1", "k2"), F.col(c)).cast("int")
        place = lambda i, j, second: F.struct(i.alias("i"), j.alias("j"), F.lit(second).alias("second"))
        every = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
        as_lead = F.when(F.col("lead"), F.transform(every("all"), lambda j: place(draw("leads"), j, False))).otherwise(F.array().cast("array<struct<i:int,j:int,second:boolean>>"))
        as_other = F.transform(every("leads"), lambda i: place(i, draw("all"), True))
        alone = F.array(place(F.lit(0), F.lit(0), False))
        spread = dealt.select("gid", "k1", "k2", F.explode(F.when((F.col("all") == 1) & F.col("whole"), alone).otherwise(F.concat(as_lead, as_other))).alias("p")).select("gid", "k1", "k2", "p.*")
        rows = spread.join(self.sets, ["k1", "k2"]).select("gid", "i", "j", "second", "k1", "k2", "shingles")
        found = rows.groupBy("gid", "i", "j").applyInArrow(_block_links(self.percent), "a1 long, a2 long, b1 long, b2 long")
        return found.distinct().select(_keyed("a1", "a2").alias("a"), _keyed("b1", "b2").alias("b"))

    def labels(self) -> DataFrame:
        """(node, label): component of each class that has a link, from enough confirmed links to join all that any chain of links joins."""
        groups = self.groups()
        crowded = bool(self.crowded.limit(1).count())
        wanted = groups.select("k1", "k2")
        self.sets = stored(self.shingle_sets((wanted.unionByName(self.crowded.select("k1", "k2")) if crowded else wanted).distinct()), "near-sets")
        links = stored(self.group_links(groups.withColumns({"lead": F.lit(True), "whole": F.lit(True)})), "near-links")
        if not crowded:
            return components(links)
        centred = stored(self.centred(), "near-centred")
        near = self.confirm(centred.filter("k1 <> c1 or k2 <> c2").select(F.col("k1").alias("a1"), F.col("k2").alias("a2"), F.col("c1").alias("b1"), F.col("c2").alias("b2")).distinct())
        links = stored(links.unionByName(near), "near-links")
        labels = components(links)
        group = labels.select("node.k1", "node.k2", "label")
        centre = group.select(F.col("k1").alias("c1"), F.col("k2").alias("c2"), F.col("label").alias("centre"))
        rows = centred.join(group, ["k1", "k2"], "left").join(centre, ["c1", "c2"], "left")
        outside = F.coalesce("label", F.struct("k1", "k2")) != F.coalesce("centre", F.struct(F.col("c1").alias("k1"), F.col("c2").alias("k2")))
        rows = stored(rows.select(F.col("node").alias("gid"), "k1", "k2", outside.alias("lead")), "near-members")
        open_nodes = rows.filter("lead").select("gid").distinct()  # the others are one component each
        more = self.group_links(rows.join(open_nodes, "gid", "left_semi").withColumn("whole", F.lit(False)))
        return components(stored(links.unionByName(more), "near-links"), known=labels)

    def named(self) -> DataFrame:
        """(k1, k2, doc_id, label): component of every class, its own key if it has no link."""
        labels = self.labels().select(F.col("node.k1").alias("k1"), F.col("node.k2").alias("k2"), "label")
        return self.classes.select("k1", "k2", "doc_id").join(labels, ["k1", "k2"], "left").withColumn(
            "label", F.coalesce("label", F.struct("k1", "k2")))

    def chosen(self) -> DataFrame:
        """(id, k1, k2) of each component: its smallest doc_id, null only if it has none, then the smallest key."""
        first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k1", "k2")).alias("m")
        return self.named().groupBy("label").agg(first).select(F.col("m.doc_id").alias("id"), "m.k1", "m.k2")

    def membership(self) -> DataFrame:
        """(doc_id, n_shingles, k1, k2, component_id): one row per input row."""
        named = self.named()
        names = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
        ids = named.join(names, "label").select("k1", "k2", "component_id")
        filled = self.members.filter("n > 0").select("doc_id", "n", "k1", "k2").join(ids, ["k1", "k2"])
        empty = self.members.filter("n = 0").select("k1", "k2", "doc_id", "n", F.col("doc_id").alias("component_id"))
        return filled.unionByName(empty).select("doc_id", F.col("n").alias("n_shingles"), "k1", "k2", "component_id")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, recall: float = RECALL) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    out = ChosenPathJoin(docs, size, percent, recall).membership()
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _set_keys(size: int):
    @F.arrow_udf("k1 long, k2 long")
    def keys(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            k1, k2 = [], []
            for part in slices(iter([pa.RecordBatch.from_arrays([column], ["text"])]), "text"):
                _, _, _, a, b = sets(*utf8(part.column("text")), size)
                k1.append(a)
                k2.append(b)
            yield pa.StructArray.from_arrays([pa.array(np.concatenate(k) if k else np.zeros(0, np.int64)) for k in (k1, k2)], ["k1", "k2"])
    return keys


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80, recall: float = RECALL) -> DataFrame:
    """The input rows without near duplicates: one row of each component, with its smallest doc_id.

    Rows are told apart by doc_id and set key, so a null or repeated id costs no text; rows without words all stay.
    """
    chosen = stored(ChosenPathJoin(docs, size, percent, recall).chosen(), "near-chosen")
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    blank = F.trim(F.coalesce("row.text", F.lit("")), F.lit(SPACE)) == ""
    keyed = rows.filter(~blank).withColumn("key", _set_keys(size)("row.text")).select("row", F.col("row.doc_id").cast("long").alias("row_id"), "key.k1", "key.k2")
    same = keyed["row_id"].eqNullSafe(chosen["id"]) & (keyed["k1"] == chosen["k1"]) & (keyed["k2"] == chosen["k2"])
    kept = keyed.join(chosen, same, "left_semi").dropDuplicates(["row_id", "k1", "k2"])
    return kept.select("row.*").unionByName(rows.filter(blank).select("row.*"))
