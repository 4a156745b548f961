"""Language identification in two steps: family first, then one-versus-one linear SVMs inside the family.

Features are hashed byte trigrams of the letters of the whole text (everything else is a blank), as frequencies. Every
binary problem (one per family against the rest, one per pair of languages inside a family) is a linear SVM fitted by
dual coordinate descent in a task of its own on a bounded sample: about ``per_language`` labelled rows of each language,
drawn by hash. Weights (32,768 numbers per problem) go to the executors; prediction is one pass without a shuffle.

Defined cases: a null text or one without a letter is ``und`` with score 0; so is every text when no row is labelled; a
single learned language is predicted with score 1. Rows repeat as given; other columns pass through untouched.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import hash_pair, slices, stored, utf8
from evalspark.operators.ordering import quantiles

# Family of common languages (ISO 639-1). Others share the family "other".
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
    "uralic": ("fi", "hu", "et"),
    "turkic": ("tr", "az", "kk"),
    "indic": ("hi", "bn", "ur", "mr"),
    "semitic": ("ar", "he"),
    "sinitic": ("zh", "yue"),
}
DIMENSIONS = 1 << 15
PER_LANGUAGE = 1000
CLEAN = 0.99
SCALE = 30.0
_LETTER = np.full(256, 32, np.uint8)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)
_EDGE = 2


def family_of(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang in langs), "other")


def trigrams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every trigram of every text (blanks stand before and after it) and where each text starts."""
    n = np.diff(off)
    padded = np.full(len(data) + _EDGE * 2 * len(n), 32, np.uint8)
    starts = off[:-1] + _EDGE * 2 * np.arange(len(n))
    padded[np.arange(len(data)) + np.repeat(_EDGE * 2 * np.arange(len(n)) + _EDGE, n)] = _LETTER[data]
    x = padded.astype(np.uint32)
    h = x[:-2] | (x[1:-1] << np.uint32(8)) | (x[2:] << np.uint32(16))
    return (h * np.uint32(2654435761)) >> np.uint32(17), starts


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _features(batches: Iterator[pa.RecordBatch]):
    """Sparse frequency vectors of the sample."""
    for batch in slices(batches, "text"):
        data, off = utf8(batch.column("text"))
        buckets, starts = trigrams(data, off)
        ends = np.append(starts[1:], len(buckets) + 2) - 2
        index, value = [], []
        for a, b in zip(starts, ends):
            u, c = np.unique(buckets[a:b], return_counts=True)
            index.append(u.astype(np.int32))
            value.append((c * (SCALE / max(1, b - a))).astype(np.float32))
        yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(index, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float32()))],
                                         ["lang", "index", "value"])


def fit_svm(rows: list[tuple[np.ndarray, np.ndarray]], sign: np.ndarray, rounds: int = 12, cost: float = 10.0) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss by dual coordinate descent; classes weigh the same."""
    w, bias = np.zeros(DIMENSIONS), 0.0
    share = {s: len(sign) / (2 * max(1, int((sign == s).sum()))) for s in (-1.0, 1.0)}
    diag = np.array([1 / (2 * cost * share[s]) for s in sign])
    square = np.array([float(v @ v) + 1.0 for _, v in rows]) + diag
    alpha = np.zeros(len(rows))
    order = np.random.default_rng(1)
    for _ in range(rounds):
        for i in order.permutation(len(rows)):
            index, value = rows[i]
            gradient = sign[i] * (w[index] @ value + bias) - 1 + diag[i] * alpha[i]
            new = max(0.0, alpha[i] - gradient / square[i])
            step = (new - alpha[i]) * sign[i]
            if step:
                w[index] += step * value
                bias += step
                alpha[i] = new
    return w, bias


def _fit(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values(["lang", "key"])
    rows = [(np.asarray(i), np.asarray(v, np.float64)) for i, v in zip(group["index"], group["value"])]
    w, bias = fit_svm(rows, group["sign"].to_numpy(np.float64))
    return pd.DataFrame({"problem": [group["problem"].iloc[0]], "weights": [w.astype("<f4").tobytes()], "bias": [bias]})


class Model:
    """Weights of all binary problems; ``families`` lists (family, its languages)."""

    def __init__(self, languages: list[str], fitted: dict[str, tuple[np.ndarray, float]]):
        groups: dict[str, list[str]] = {}
        for lang in sorted(languages):
            groups.setdefault(family_of(lang), []).append(lang)
        self.families = sorted(groups.items())
        self.names = sorted(fitted)
        self.column = {p: i for i, p in enumerate(self.names)}
        self.weights = np.stack([fitted[p][0] for p in self.names]) if fitted else np.zeros((0, DIMENSIONS), np.float32)
        self.bias = np.array([fitted[p][1] for p in self.names])
        self.strength = np.abs(self.weights).max(axis=0, initial=0)

    def margins(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """One column per problem; the last is the evidence: mean strength of a text's trigrams, whichever side they speak for."""
        buckets, starts = trigrams(data, off)
        if len(off) < 2:
            return np.zeros((0, len(self.names) + 1))
        ends = np.append(starts[1:], len(buckets) + 2) - 2
        cuts = np.stack([starts, ends], 1).ravel()
        scale = SCALE / np.maximum(1, ends - starts)
        buckets = np.append(buckets, np.uint32(0))  # so that the last end is a valid place
        out = [np.add.reduceat(w[buckets], cuts, dtype=np.float64)[::2] * scale + b for w, b in zip([*self.weights, self.strength], [*self.bias, 0.0])]
        return np.stack(out, 1)

    def predict(self, data: np.ndarray, off: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Names, scores and evidence (infinite when only one language is learned)."""
        m, n = self.margins(data, off), len(off) - 1
        if len(self.families) > 1:
            f = np.stack([m[:, self.column[f"family {name}"]] for name, _ in self.families], 1)
            e = np.exp(2 * (f - f.max(1, keepdims=True)))
            family, trust = f.argmax(1), e.max(1) / e.sum(1)
        else:
            family, trust = np.zeros(n, int), np.ones(n)
        names, score = np.empty(n, object), trust.copy()
        for k, (_, langs) in enumerate(self.families):
            at = np.flatnonzero(family == k)
            if len(langs) == 1:
                names[at] = langs[0]
                continue
            votes, total, sure = (np.zeros((len(at), len(langs))) for _ in range(3))
            for i, j in itertools.combinations(range(len(langs)), 2):
                x = m[at, self.column[f"pair {langs[i]} {langs[j]}"]]
                p = 1 / (1 + np.exp(-np.clip(2 * x, -50, 50)))
                for to, y, q in ((i, x, p), (j, -x, 1 - p)):
                    votes[:, to] += y > 0
                    total[:, to] += np.clip(y, -5, 5)
                    sure[:, to] += q
            best = np.lexsort((np.tile(-np.arange(len(langs)), (len(at), 1)), total, votes), axis=1)[:, -1]
            names[at] = np.array(langs, object)[best]
            score[at] *= sure[np.arange(len(at)), best] / (len(langs) - 1)
        return list(names), score, m[:, -1] if self.names else np.full(n, np.inf)


def _draw(seed: int) -> Column:
    """A number in [0, 1) by id and text, so that null or repeated ids spread."""
    return F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(1 << 20)) / float(1 << 20)


def _sizes(labelled: DataFrame, seed: int) -> dict[str, tuple[int, float]]:
    """Rows of each language and the smallest draw among them."""
    counts = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min(_draw(seed)).alias("least"))
    return {r["lang"]: (r["n"], r["least"]) for r in counts.collect()}


def _sample(labelled: DataFrame, sizes: dict[str, tuple[int, float]], per_language: int, seed: int) -> DataFrame:
    """About ``per_language`` rows of each language, at least one; copies of a text (alike in what a draw sees) count once."""
    share = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(max(per_language / n, least))) for lang, (n, least) in sorted(sizes.items())])
    return labelled.filter(_draw(seed) <= share).dropDuplicates(["lang", "doc_id", "text"])


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE, seed: int = 17) -> Model:
    """Learn from rows (doc_id, text, lang); ``per_language`` bounds the expected sample of each language.

    Driver memory: one count per language and 128 KB per binary problem.
    """
    labelled = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.trim("text") != ""))
    sizes = _sizes(labelled, seed)
    if not sizes:
        return Model([], {})
    chosen = _sample(labelled.select("doc_id", "lang", "text"), sizes, per_language, seed).select("lang", "text")
    sample = stored(chosen.mapInArrow(_features, "lang string, index array<int>, value array<float>"), "language-sample")
    langs = sorted(sizes)
    groups: dict[str, list[str]] = {}
    for lang in langs:
        groups.setdefault(family_of(lang), []).append(lang)
    problems = [(f"family {f}", lang, 1.0 if lang in own else -1.0) for f, own in groups.items() if len(groups) > 1 for lang in langs]
    problems += [(f"pair {a} {b}", lang, sign) for own in groups.values() for a, b in itertools.combinations(own, 2)
                 for lang, sign in ((a, 1.0), (b, -1.0))]
    if not problems:
        return Model(langs, {})
    plan = sample.sparkSession.createDataFrame(problems, "problem string, lang string, sign double")
    keyed = sample.withColumn("key", F.xxhash64("index", "value"))
    fitted = (keyed.join(plan, "lang").groupBy("problem")
              .applyInPandas(_fit, "problem string, weights binary, bias double").collect())
    return Model(langs, {r["problem"]: (np.frombuffer(r["weights"], "<f4"), r["bias"]) for r in fitted})


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Columns ``row`` (the input row), ``lang_pred``, ``score`` and ``evidence`` (0 for ``und``)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double, evidence double")
    def guess(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        for column in texts:
            names, scores, evidence = [], [], []
            for part in slices(iter([pa.RecordBatch.from_arrays([column], ["text"])]), "text"):
                letters = [has_letter(t) and bool(own.families) for t in part.column("text").to_pylist()]
                got, sure, won = own.predict(*utf8(part.column("text"))) if own.families else ([None] * part.num_rows, *np.zeros((2, part.num_rows)))
                names += [g if ok else "und" for g, ok in zip(got, letters)]
                scores += [min(1.0, max(0.0, float(x))) if ok else 0.0 for x, ok in zip(sure, letters)]
                evidence += [float(x) if ok else 0.0 for x, ok in zip(won, letters)]
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(evidence, pa.float64())],
                                             ["lang_pred", "score", "evidence"])

    got = guess("row.text")
    return docs.select(F.struct(*docs.columns).alias("row")).select("row", got.alias("out")).select(
        "row", F.col("out.lang_pred").alias("lang_pred"), F.col("out.score").alias("score"), F.col("out.evidence").alias("evidence"))


def held_out(doc_id: Column) -> Column:
    """Rows kept for measuring: remainder 2 of crc32(id as text) by 4; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def learn_and_predict(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    model = fit(docs.filter(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"), per_language)
    return predict(docs, model).withColumn("held_out", held_out(F.col("row.doc_id")))


def least_evidence(labelled: DataFrame, model: Model) -> dict[str, float]:
    """Evidence below which a text is in none of the learned languages, for each language with rows the model gets right.

    Half the evidence that ``CLEAN`` of all labelled rows reach, which the model must not have learned from; copies of a
    text (alike in what a draw sees) count once. The quantile is exact and no task holds a language.
    """
    right = predict(labelled.filter(F.col("lang").isNotNull()), model).filter(F.col("lang_pred") == F.col("row.lang"))
    first, second = hash_pair(F.col("row.text"))
    right = right.select("lang_pred", "evidence", "row.doc_id", first.alias("_h"), second.alias("_g")).dropDuplicates(["lang_pred", "doc_id", "_h", "_g"])
    # Stored: the quantiles read it several times, and each reading would predict anew.
    low = quantiles(stored(right.select("lang_pred", "evidence"), "language-evidence"), ["lang_pred"], "evidence", [1 - CLEAN], ["m"]).collect()
    return {r["lang_pred"]: r["m"] / 2 for r in low}


def learn_and_reject(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """Columns of ``predict`` for the rows that are in a learned language: others have trigrams of little weight, however many classes there are."""
    labelled = docs.select("doc_id", "text", "lang")
    model = fit(labelled.filter(~held_out(F.col("doc_id"))), per_language)
    least = least_evidence(labelled.filter(held_out(F.col("doc_id"))), model)
    known = F.lit(True)
    for lang, m in sorted(least.items()):
        known = F.when(F.col("lang_pred") == lang, F.col("evidence") >= m).otherwise(known)
    return predict(docs, model).filter((F.col("lang_pred") != "und") & known)
