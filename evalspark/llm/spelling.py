"""Spelling variants: words one edit apart, by search schemes on bidirectional FM-indexes over shards of the vocabulary.

1. Words are counted by Spark (partial sums before the shuffle). The vocabulary holds what is long and frequent enough.
2. A word with one edit keeps its left half as a prefix or its right half as a suffix. Every word asks once per side, under its half; it is
   indexed under the halves that words one shorter, as long and one longer would ask for. Right halves are handled as left
   halves of reversed words. Halves are dealt to shards of about ``SHARD`` words; a half with more indexed words than that is
   cut into blocks, each of which all its askers visit.
3. A shard's FM-index covers its words between delimiters, in both directions, with intervals kept in step. The search scheme
   matches the asker's half exactly, from its end back to the opening delimiter, then extends across the other half to the
   closing delimiter with exactly one inserted, deleted or replaced code point. The rank that is left names the word.
   Each edit is tried in one place of a run of equal letters, and the second side passes over words that share the left
   half, so no word is found twice.
4. Per asker and shard one row leaves (number of near words, the most frequent of them); a sum joins the shards.
5. Chains of forms shorten by doubling: each form is at least ``ratio`` times as frequent, so few rounds are needed.

Defined cases: a null text has no words; a null doc_id reads as the empty string; rows repeating a doc_id count each; an
empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.bwt import suffix_order
from evalspark.llm.common import LOWER, UPPER, stored

RUN = "[a-zÀ-ÿ]{%d,}"
SHARD = 8192
ASKERS = 4096


def document_words(docs: DataFrame, every: int = 31, min_length: int = 7) -> DataFrame:
    """(word): every run of letters that is long enough after losing the code point that its checksum names."""
    text = F.translate("text", UPPER, LOWER)
    # Shorter runs end too short, with or without the deletion.
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text, F.lit(RUN % min_length), F.lit(0))).alias("run"))
    h, n = F.crc32(F.concat_ws(":", "id", "run")), F.char_length("run")
    at = F.pmod(h, n).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, n))
    return runs.select(F.when(h % every == 0, cut).otherwise(F.col("run")).alias("word")).filter(F.char_length("word") >= min_length)


def vocabulary(docs: DataFrame, every: int = 31, min_length: int = 7, min_count: int = 2) -> DataFrame:
    """(word, n) of the words that occur often enough."""
    return document_words(docs, every, min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)


class FmIndex:
    """Distinct words between delimiters (symbol 0); intervals of sorted suffixes in both directions."""

    def __init__(self, words: list[str]):
        joined = np.frombuffer(("\0" + "\0".join(words) + "\0").encode("utf-32-le"), np.uint32)
        self.alphabet, text = np.unique(joined, return_inverse=True)
        depth = max(map(len, words)) + 2  # patterns hold a word and two delimiters at most
        self.starts = np.flatnonzero(text == 0)[:-1]
        self.order, self.below, self.first = self._direction(text, depth)
        _, self.below_back, _ = self._direction(text[::-1].copy(), depth)
        self.size = len(text)

    def _direction(self, text: np.ndarray, depth: int):
        """Suffix order; below[i, c]: symbols smaller than c before the first i sorted suffixes; first[c]: suffixes that start below c."""
        order = suffix_order(text, depth)
        before = text[order - 1]
        wide = len(self.alphabet)
        below = np.zeros((len(text) + 1, wide + 1), np.int32)
        below[np.arange(1, len(text) + 1), before + 1] = 1
        np.cumsum(below, axis=0, out=below)
        np.cumsum(below, axis=1, out=below)
        return order, below, below[-1].copy()

    def extend(self, below, lo, other, size, c):
        """Intervals after one more symbol at the side of ``below``: (lo, other, size), empty where size is 0."""
        low_a, low_b = below[lo, c], below[lo, c + 1]
        hi = lo + size
        high_a, high_b = below[hi, c], below[hi, c + 1]
        skipped, taken = low_b - low_a, high_b - high_a
        return self.first[c] + skipped, other + (high_a - low_a), taken - skipped

    def left(self, lo, back, size, c):
        return self.extend(self.below, lo, back, size, c)

    def right(self, lo, back, size, c):
        back, lo, size = self.extend(self.below_back, back, lo, size, c)
        return lo, back, size

    def words_at(self, lo: np.ndarray) -> np.ndarray:
        """The word that each interval of a whole delimited word names."""
        return np.searchsorted(self.starts, self.order[lo])


def one_edit(index: FmIndex, words: list[str], exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(asker, indexed word): words whose first ``exact`` symbols are the asker's and which are one edit away."""
    sizes = np.array([len(w) for w in words])
    letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    code = np.searchsorted(index.alphabet, letters)
    known = index.alphabet[np.minimum(code, len(index.alphabet) - 1)] == letters
    pattern = np.zeros((len(words), int(sizes.max()) + 2), np.int64)  # ends in delimiters
    pattern[np.repeat(np.arange(len(words)), sizes), np.arange(len(letters)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.where(known, code, -1)

    def step(way, state, symbol):
        lo, back, size = way(state[2], state[3], state[4], np.maximum(symbol, 0))
        keep = (size > 0) & (symbol >= 0)
        return [x[keep] for x in (state[0], state[1], lo, back, size)]

    q = np.arange(len(words))
    state = [q, np.asarray(exact, np.int64).copy(), np.zeros(len(q), np.int64), np.zeros(len(q), np.int64), np.full(len(q), index.size, np.int64)]
    for back in range(int(exact.max()) if len(words) else 0):  # the exact half, from its end; then the opening delimiter
        here = state[1] > 0
        moved = step(index.left, [x[here] for x in state], pattern[state[0][here], state[1][here] - 1])
        moved[1] = moved[1] - 1
        state = [np.concatenate([a, b[~here]]) for a, b in zip(moved, state)]
    state = step(index.left, state, np.zeros(len(state[0]), np.int64))
    state[1] = np.asarray(exact, np.int64)[state[0]]
    erred = []
    while len(state[0]):
        q, j = state[0], state[1]
        want = pattern[q, j]
        inside = j < sizes[q]
        # Every symbol that follows in the index: as a replacement (go on behind j) or an insertion (go on at j).
        counts = index.below_back[state[3] + state[4], 1:] - index.below_back[state[3], 1:]
        counts = np.diff(counts, axis=1)  # without the delimiter
        row, symbol = np.nonzero(counts)
        symbol = symbol + 1
        other = symbol != want[row]
        row, symbol = row[other], symbol[other]
        children = step(index.right, [x[row] for x in state], symbol)
        swap = inside[row]
        erred.append([children[0][swap], children[1][swap] + 1, *[x[swap] for x in children[2:]]])
        erred.append(children)
        drop = inside & ((j == np.asarray(exact)[q]) | (want != pattern[q, np.maximum(j - 1, 0)]))
        erred.append([q[drop], j[drop] + 1, *[x[drop] for x in state[2:]]])
        state = step(index.right, [x[inside] for x in state], want[inside])
        state[1] = state[1] + 1
    state = [np.concatenate(x) for x in zip(*erred)] if erred else [np.zeros(0, np.int64)] * 5
    asker, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(state[0]):
        ends = state[1] == sizes[state[0]]
        state = step(index.right, state, pattern[state[0], state[1]])
        ends = state[1] == sizes[state[0]]
        asker.append(state[0][ends])
        found.append(index.words_at(state[2][ends]))
        state = [x[~ends] for x in state]
        state[1] = state[1] + 1
    return np.concatenate(asker), np.concatenate(found)


_FOUND = "word string, n_near long, best_n long, best string"


def _search_shard():
    """One shard of one side: per asker the number of near words and the most frequent of them."""
    def fn(group: pa.Table) -> pa.Table:
        asks = group.filter(group.column("asks"))
        held = group.filter(pc.invert(group.column("asks"))).select(["word", "n"])
        names, n_near, best_n, best = [], [], [], []
        if asks.num_rows and held.num_rows:
            side = asks.column("side")[0].as_py()
            n_of = dict(zip(held.column("word").to_pylist(), held.column("n").to_pylist()))  # a word may lie here under two halves
            words = sorted(n_of)
            plain = words if side == 0 else [w[::-1] for w in words]
            count = np.array([n_of[w] for w in words], np.int64)
            rank = np.empty(len(words), np.int64)
            rank[np.lexsort((_by_code_point(plain), -count))] = np.arange(len(words))
            index = FmIndex(words)
            own = asks.column("word").to_pylist()
            for i in range(0, len(own), ASKERS):
                part = own[i:i + ASKERS]
                exact = np.array([half_length(len(w), side) for w in part])
                q, u = one_edit(index, part, exact)
                if side:  # these were found from the left
                    keep = np.array([not plain[y].startswith(part[x][::-1][:half_length(len(part[x]), 0)]) for x, y in zip(q.tolist(), u.tolist())], bool)
                    q, u = q[keep], u[keep]
                order = np.lexsort((rank[u], q))
                q, u = q[order], u[order]
                heads = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
                names += [part[x] if side == 0 else part[x][::-1] for x in q[heads].tolist()]
                n_near += np.diff(np.append(heads, len(q))).tolist()
                best_n += count[u[heads]].tolist()
                best += [plain[x] for x in u[heads].tolist()]
        return pa.table([pa.array(names, pa.string()), pa.array(n_near, pa.int64()), pa.array(best_n, pa.int64()), pa.array(best, pa.string())],
                        ["word", "n_near", "best_n", "best"])
    return fn


def _by_code_point(words: list[str]) -> np.ndarray:
    place = np.empty(len(words), np.int64)
    place[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    return place


def half_length(n: int, side: int) -> int:
    return n // 2 if side == 0 else n - n // 2


def near_words(words: DataFrame, min_length: int, shard: int = SHARD) -> DataFrame:
    """(word, n_near, best_n, best) of the words of a stored vocabulary that have a near word."""
    n = F.char_length("word")
    sides = words.select("n", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("word").alias("word")), F.struct(F.lit(1).alias("side"), F.reverse("word").alias("word")))).alias("s")).select("n", "s.*")
    half = lambda size: F.when(F.col("side") == 0, F.floor(size / 2)).otherwise(F.ceil(size / 2)).cast("int")
    keyed = lambda size: F.substring(F.col("word"), F.lit(1), size)
    asks = sides.select("side", keyed(half(n)).alias("half"), "word", "n", F.lit(True).alias("asks"))
    lengths = F.array_distinct(F.array(half(F.greatest(n - 1, F.lit(min_length))), half(n), half(n + 1)))
    held = sides.select("side", "word", "n", F.explode(lengths).alias("h")).select("side", keyed(F.col("h")).alias("half"), "word", "n", F.lit(False).alias("asks"))
    crowded = held.groupBy("side", "half").agg(F.ceil(F.count(F.lit(1)) / shard).cast("int").alias("blocks")).filter("blocks > 1")
    shards = max(1, 2 * words.count() // shard)  # about two indexed rows a word and side
    both = asks.unionByName(held).join(crowded, ["side", "half"], "left")
    block = F.when(F.col("asks"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")))
    # Crowded halves have shards of their own (negative), so that no word meets another twice.
    own = F.transform(block, lambda b: -1 - F.abs(F.xxhash64("half", b) % (1 << 40)))
    dealt = both.withColumn("shard", F.explode(F.when(F.col("blocks").isNull(), F.array(F.pmod(F.xxhash64("half"), F.lit(shards)))).otherwise(own)))
    found = dealt.select("side", "shard", "word", "n", "asks").groupBy("side", "shard").applyInArrow(_search_shard(), _FOUND)
    best = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("word"))).alias("b")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.word").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form (columns word, form), by doubling."""
    chain = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        far = chain.select(F.col("word").alias("root"), F.col("root").alias("far"))
        chain = stored(chain.join(far, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "spelling-roots")
        if not chain.filter("moved").limit(1).count():
            return chain.select("word", "root")
        chain = chain.select("word", "root")


def spelling_variants(docs: DataFrame, every: int = 31, min_length: int = 7, min_count: int = 2, ratio: int = 10, shard: int = SHARD) -> DataFrame:
    """One row per word: word, n, n_near, form, form_n, root."""
    words = stored(vocabulary(docs, every, min_length, min_count), "spelling-words")
    near = near_words(words, min_length, shard)
    has_form = F.col("best_n") >= ratio * F.col("n")
    out = stored(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has_form, F.col("best")).alias("form"),
                                                         F.when(has_form, F.col("best_n")).alias("form_n")), "spelling-forms")
    last = roots(out.filter("form is not null"))
    return out.join(last, "word", "left").withColumn("root", F.coalesce("root", "word"))
