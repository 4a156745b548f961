"""Operators against plain Python on small tables."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalspark.llm import ann, bwt, chat, exact_topk, language_id, line_dedup, mixing, near_dedup, packing, repeats, url_rules

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, t1 string, row string"


def docs(spark, rows):
    """Rows (doc_id, text[, lang, source]) with extra columns whose names clash with inner ones."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or ""), "x", "y") for r in rows]
    return spark.createDataFrame(full, DOCS)


def hard_rows():
    prose = [" ".join(f"word{(i * 7 + j * j) % 97}" for j in range(60)) for i in range(12)]
    passage = " ".join(f"shared{j}" for j in range(45))
    rows = [(i, f"Head {i}\n{p}\n  COMMON line \nTail") for i, p in enumerate(prose)]
    rows += [(20 + i, f"{prose[i]} {passage} {prose[i][::-1]}") for i in range(4)]
    rows += [(30, None), (31, ""), (32, " \n\t "), (33, "a" * 950), (34, "one"), (35, "ONE"), (36, "été 12 \U0001f600 ß"), (None, prose[0]), (37, prose[0]),
             (37, prose[0]), (37, prose[1]), (38, "common LINE\ncommon line"), (39, prose[2] + " x"), (40, "\n".join(["dup line of text"] * 3)), (41, (prose[3] + " ") * 40)]
    return rows


# line dedup

def lines_brute(rows, min_chars, min_docs, keep_first):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    where = defaultdict(set)
    for d, t, *_ in rows:
        for line in (t or "").split("\n"):
            where[key(line)].add((d, t or ""))
    gone = {k for k, v in where.items() if len(k) >= min_chars and len(v) >= min_docs}
    order = lambda d: (d[0] is not None, d[0] if d[0] is not None else 0)
    first = {k: min(order(d) for d in where[k]) for k in gone}
    out = []
    for d, t, *_ in rows:
        kept, seen, n = [], set(), (t or "").split("\n")
        for line in n:
            k = key(line)
            if k in gone and not (keep_first and order((d, t)) == first[k] and k not in seen):
                continue
            seen.add(k)
            kept.append(line)
        out.append((d, len(n), len(n) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("min_docs,keep_first", [(3, False), (3, True), (10, False), (1, False)])
def test_line_dedup(spark, min_docs, keep_first):
    rows = list(dict.fromkeys(hard_rows()))
    df = docs(spark, rows).repartition(5)
    out = line_dedup.dedup_lines(df, 1, min_docs, keep_first).select("row.doc_id", "out.n_lines", "out.n_dropped", "out.kept_sha256")
    assert sorted((tuple(r) for r in out.collect()), key=str) == lines_brute(rows, 1, min_docs, keep_first)


def test_line_dedup_repeated_rows_agree(spark):
    rows = [(1, "a line\nb"), (1, "a line\nb"), (2, "a line"), (3, "a line\nc")]
    got = line_dedup.dedup_lines(docs(spark, rows), 1, 3, True).select("row.doc_id", F.coalesce("out.changed", "row.text")).collect()
    assert sorted((r[0], r[1]) for r in got) == [(1, "a line\nb"), (1, "a line\nb"), (2, ""), (3, "c")]


def test_line_runs_across_partitions(spark):
    rows = [(i, "same line\nown %d" % i) for i in range(60)]
    out = line_dedup.dedup_lines(docs(spark, rows), 1, 10, True).select("row.doc_id", "out.n_dropped").collect()
    assert {r[0]: r[1] for r in out} == {i: int(i > 0) for i in range(60)}


# repeated strings

def repeats_brute(rows, length):
    texts = [(t or "").encode() for _, t, *_ in rows]
    seen = defaultdict(list)
    for i, b in enumerate(texts):
        for s in range(len(b) - length + 1):
            seen[b[s:s + length]].append((i, s))
    masks = [np.zeros(len(b), bool) for b in texts]
    for places in seen.values():
        if len(places) > 1:
            for i, s in places:
                masks[i][s:s + length] = True
    out = []
    for (d, *_), b, m in zip(rows, texts, masks):
        kept = bytes(x for x, g in zip(b, m) if not g)
        out.append((d, len(b), int(m.sum()), int((np.diff(np.concatenate([[0], m.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("crowded", [2000, 1])
def test_repeats(spark, crowded):
    rows = hard_rows()
    out = repeats.remove_repeats(docs(spark, rows), 200, crowded=crowded).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted((tuple(r) for r in out.collect()), key=str) == repeats_brute(rows, 200)


def test_repeats_on_documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r[0], r[1]) for r in df.select("doc_id", "text").collect()]
    out = repeats.remove_repeats(df, 200, shard_bytes=20000).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted((tuple(r) for r in out.collect()), key=str) == repeats_brute(rows, 200)


def test_bwt_borders():
    rng = np.random.default_rng(0)
    for length in (1, 3, 5):
        strings = [bytes(rng.integers(97, 99, rng.integers(0, 40)).astype(np.uint8)) for _ in range(9)]
        count = defaultdict(int)
        for s in strings:
            for i in range(len(s) - length + 1):
                count[s[i:i + length]] += 1
        want = [[count[s[i:i + length]] > 1 for i in range(len(s) - length + 1)] for s in strings]
        assert [m.tolist() for m in bwt.repeated_starts(strings, length)] == want


# near duplicates

def near_brute(rows, size, percent):
    sets = []
    for _, t, *_ in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "")).replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        w = [x for x in w if x]
        sets.append({tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    names = {}
    for i, (d, *_) in enumerate(rows):
        if d is not None:
            names[find(i)] = min(names.get(find(i), d), d)
    return sorted(((d, len(s), names.get(find(i)), d == names.get(find(i))) for i, ((d, *_), s) in enumerate(zip(rows, sets))), key=str)


def near_rows():
    rng = np.random.default_rng(3)
    base = [f"w{x}" for x in rng.integers(0, 5000, 150)]
    rows = hard_rows()
    for i in range(40):
        changed = list(base)
        for j in rng.integers(0, 150, i % 7):
            changed[j] = f"new{i}_{j}"
        rows.append((100 + i, " ".join(changed)))
    return rows


@pytest.mark.parametrize("limit,block", [(2048, 2048), (64, 5), (3, 7)])
def test_near_duplicates(spark, limit, block):
    rows = near_rows()
    join = near_dedup.ChosenPathJoin(docs(spark, rows), 4, 80, node_limit=limit, block_rows=block, block_shingles=10_000)
    out = join.membership().select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")))
    assert sorted((tuple(r) for r in out.collect()), key=str) == near_brute(rows, 4, 80)


def test_set_intersections(monkeypatch):
    rng = np.random.default_rng(5)
    left, right = ([np.unique(rng.integers(0, 400, rng.integers(0, 90)).astype(np.uint64)) for _ in range(n)] for n in (70, 90))
    want = [[len(set(a.tolist()) & set(b.tolist())) for b in right] for a in left]
    for often in (0, 10, 1000):
        monkeypatch.setattr(near_dedup, "OFTEN", often)
        assert near_dedup.intersections(left, right).tolist() == want


def test_near_duplicates_recall(spark):
    """Pairs just above the threshold, with others just below it around them: what the token filter and the trees lose, measured."""
    rng = np.random.default_rng(8)
    rows = []
    for g in range(400):
        words = [f"g{g}w{i}" for i in range(123)]  # 120 shingles of four words
        other = list(words)
        other[40] = other[90] = "x"  # 8 of them differ on each side: 112 / 128 = 0.875
        third = list(other)
        third[int(rng.integers(45, 60))] = "y"  # 0.76 from the first, 0.87 from the second
        rows += [(3 * g, " ".join(words)), (3 * g + 1, " ".join(other)), (3 * g + 2, " ".join(third))]
    got = near_dedup.near_duplicates(docs(spark, rows), 4, 80).select("doc_id", "component_id").collect()
    assert {r[0]: r[1] for r in got} == {i: i // 3 * 3 for i in range(1200)}


def test_near_duplicates_many_null_and_repeated_ids(spark):
    texts = [" ".join(f"t{i}w{j}" for j in range(30)) for i in range(150)]
    rows = [(None, t) for t in texts] + [(None, t + " end") for t in texts] + [(7, t + " END") for t in texts]
    join = near_dedup.ChosenPathJoin(docs(spark, rows), 4, 80)
    assert join.shingle_sets(join.classes.select("k1", "k2")).count() == 300
    got = join.membership().select("k1", "k2", "doc_id", "component_id").collect()
    assert len(got) == 450 and {r["component_id"] for r in got} == {7}


def test_near_duplicates_on_documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r[0], r[1]) for r in df.select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in near_dedup.near_duplicates(df, 4, 80).collect()), key=str) == near_brute(rows, 4, 80)


def test_keep_one(spark):
    got = near_dedup.keep_one(docs(spark, near_rows()), 4, 80)
    assert got.columns == DOCS.replace(" long", "").replace(" string", "").split(", ")
    ids = [r["doc_id"] for r in got.collect()]
    assert len(ids) == len(set(ids)) and set(ids) == {r[0] for r in near_brute(near_rows(), 4, 80) if r[3]}


def test_keep_one_null_and_repeated_ids(spark):
    a, b, c, d, e = (" ".join(f"{x}{j}" for j in range(50)) for x in "abcde")
    rows = [(None, a), (None, b), (None, b + " more"), (None, ""), (None, None), (5, c), (5, d), (5, d), (6, e), (None, e + " more")]
    got = [tuple(r) for r in near_dedup.keep_one(docs(spark, rows), 4, 80).select("doc_id", "text").collect()]
    assert sorted(r[1][0] for r in got if r[1]) == ["a", "b", "c", "d", "e"]
    assert (6, e) in got and (5, c) in got and (5, d) in got and (None, a) in got
    assert sorted(str(r) for r in got if not r[1]) == ["(None, '')", "(None, None)"]


# packing

def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    rows = hard_rows() + [(50, "Word, WORD. d'été! <|endoftext|> x\x1cy \u0130stanbul \u03a3\u03a3 e\u0301"), (51, "long text " * 5000),
                          (52, "x <|endoftext|> y"), (53, "a<|startoftext|>b <|ENDOFTEXT|> <| |>"), (54, "plain words only")]
    t = Tokenizer.from_file(packing.tokenizer_path())
    assert t.encode("x <|endoftext|> y", add_special_tokens=False).ids == [343, 49407, 344]
    want = []
    for d, text, *_ in rows:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        want += [(d, i, s, len(ids[s:s + 2048]), zlib.crc32(ids[s:s + 2048].tobytes())) for i, s in enumerate(range(0, len(ids), 2048))]
    out = packing.pack_documents(docs(spark, rows), group_rows=8).collect()
    assert sorted((tuple(r)[:5] for r in out), key=str) == sorted(want, key=str)
    bins = defaultdict(list)
    for r in out:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= math.ceil(sum(w[3] for w in want) / 2048) + 1


def test_equal_rows_are_dealt_apart(spark):
    pieces = spark.createDataFrame([(None, 0, 0, 700, 5)] * 400, "doc_id long, piece int, start long, length long, ids_crc32 long").repartition(4)
    out = packing.pack(packing.stored(pieces, "equal"), group_rows=20)
    assert out.select("sequence_id").distinct().count() == 200  # two to a sequence, at best
    assert out.select((F.col("sequence_id") / (1 << 20)).cast("long")).distinct().count() > 10


def test_exchange_goes_on_until_it_saves_nothing(spark):
    rng = np.random.default_rng(4)
    lengths = rng.integers(1, 1200, 3000).tolist()
    pieces = packing.stored(spark.createDataFrame([(i, 0, 0, n, i) for i, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long"), "lengths")
    out = packing.pack(pieces, group_rows=200).select("sequence_id", "offset", "length").collect()
    bound = packing.least_bins(np.bincount(lengths, minlength=2049), 2048)
    assert len({r["sequence_id"] for r in out}) <= bound + 5  # 15 groups, each a bin or more above its share before the exchange
    fill = defaultdict(list)
    for r in out:
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
    assert all(sum(n for _, n in v) <= 2048 and sorted(v)[0][0] == 0 for v in fill.values()) and len(out) == 3000


def test_least_bins_bounds_best_fit():
    rng = np.random.default_rng(1)
    for _ in range(200):
        lengths = np.sort(rng.integers(1, 101, rng.integers(1, 30)))[::-1]
        where, _ = packing.best_fit_decreasing(lengths, 100)
        bound = packing.least_bins(np.bincount(lengths, minlength=101), 100)
        assert math.ceil(lengths.sum() / 100) <= bound <= where.max() + 1


# search

def vectors(spark, n=700, d=8, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)).astype(np.float32)
    x[5] = x[25] = x[45] = x[60]
    rows = [(i, [float(v) for v in x[i]], 1, "c") for i in range(n)]
    rows += [(n, None, 1, "c"), (n + 20, [float("nan")] * d, 1, "c"), (n + 40, [None] * d, 1, "c"), (n + 60, [0.0] * d, 1, "c"), (None, [1.0] * d, 1, "c")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, shard string"), x


def test_exact_search(spark):
    df, x = vectors(spark)
    got = exact_topk.search(df, F.col("vec_id") % 20 == 0, 20, 64.0, tile_rows=100).collect()
    q = np.floor(64 * np.vstack([x.astype(np.float64), np.zeros((1, 8))])).astype(int)
    ids = np.append(np.arange(700), 760)
    want = set()
    for i in np.flatnonzero(ids % 20 == 0):
        s = q @ q[i]
        order = [j for j in np.lexsort((ids, -s)) if j != i][:20]
        want |= {(int(ids[i]), r + 1, int(ids[j]), int(s[j])) for r, j in enumerate(order)}
    assert {tuple(r) for r in got} == want


def test_repeated_query_ids(spark):
    rng = np.random.default_rng(6)
    x = [[float(v) for v in r] for r in rng.normal(size=(60, 4))]
    rows = [(i, v) for i, v in enumerate(x)] + [(20, x[20]), (40, x[3])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    for out in (exact_topk.search(df, F.col("vec_id") % 20 == 0, 10), ann.search(df, F.col("vec_id") % 20 == 0, 10)):
        lists = defaultdict(list)
        for r in out.collect():
            lists[r["query_id"]].append(r["vec_id"])
        assert {q: len(v) for q, v in lists.items()} == {0: 10, 20: 10, 40: 10}
        assert all(len(set(v)) == 10 for q, v in lists.items() if q != 0)  # 20 and 40 are candidates of 0 twice


def test_exact_search_large_numbers(spark):
    df = spark.createDataFrame([(0, [1e7, 3e6]), (1, [2e5, -1e7]), (2, [1e30, 1.0])], "vec_id long, embedding array<double>")
    got = {(r[0], r[2]): r[3] for r in exact_topk.search(df, F.col("vec_id") % 20 == 0).collect()}
    assert got[(0, 1)] == 640000000 * 12800000 - 192000000 * 640000000
    assert got[(0, 2)] == 2 ** 63 - 1


def test_graph_search_recall(spark):
    df, x = vectors(spark, 3000, 16)
    got = ann.search(df, F.col("vec_id") % 20 == 0, 20, shard_rows=800).collect()
    x = x.astype(np.float64)
    found = defaultdict(dict)
    for r in got:
        found[r["query_id"]][r["rank"]] = (r["vec_id"], r["score"])
    hit = 0
    for i in range(0, 3000, 20):
        s = x @ x[i]
        best = [j for j in np.lexsort((np.arange(3000), -s)) if j != i][:20]
        assert sorted(found[i]) == list(range(1, 21))
        listed = [found[i][r] for r in range(1, 21)]
        assert all(abs(score - s[v]) < 1e-9 and v != i for v, score in listed)
        assert listed == sorted(listed, key=lambda p: (-p[1], p[0]))
        hit += len({v for v, _ in listed} & set(best))
    assert hit / (150 * 20) >= 0.95 and set(found) == set(range(0, 3000, 20))


# url rules

def test_url_parts_and_rules(spark):
    rows = [(1, "http://Www.Example.com/en/1?q"), (2, "https://a.b.net/es/x#t"), (3, "nourl"), (4, None), (5, "x://example.com"), (6, "ftp://notexample.com/en/"),
            (7, "http://example.com?/en/"), (8, "http://spam.org/a"), (1, "http://Www.Example.com/en/1?q"), (9, "://h.net/fr/")]
    got = url_rules.judge(spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, host string")).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted([
            (1, "www.example.com", "/en/1", "www.example.com/en/", "allow"), (1, "www.example.com", "/en/1", "www.example.com/en/", "allow"),
            (2, "a.b.net", "/es/x", "net/es/", "block"), (3, "", "", None, "allow"), (4, "", "", None, "allow"), (5, "example.com", "", None, "allow"),
            (6, "notexample.com", "/en/", "com/", "allow"), (7, "example.com", "", None, "allow"), (8, "spam.org", "/a", None, "allow"), (9, "h.net", "/fr/", "net/fr/", "block")], key=str)


def test_mined_rules(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(300):
        items = [t for t in ("a", "b", "c", "d") if rng.random() < 0.6]
        rows.append((items, "block" if {"a", "b"} <= set(items) else "allow"))
    got = url_rules.mined_rules(spark.createDataFrame(rows, "items array<string>, verdict string"), 0.01, 0.9).collect()
    assert {tuple(r["items"]) for r in got} == {("a", "b")} and got[0]["confidence"] == 1.0


# mixing

def test_mixing_targets(spark):
    rows = [(i, "w " * (i % 9), "en", f"s{i % 4}" if i % 5 else None) for i in range(400)] + [(900, None, "en", "s9"), (1, "w " * 1, "en", "s1")]
    got = mixing.taken_words(docs(spark, rows)).collect()
    assert len(got) == len(rows) and all(r["taken"] <= 3 * r["size"] for r in got)
    size, target, taken = defaultdict(int), {}, defaultdict(int)
    for r in got:
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    names = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    share, fixed, total = {}, set(), sum(size.values())
    while True:
        rest = total - sum(3 * size[s] for s in fixed)
        share = {s: 3 * size[s] if s in fixed else rest * weight[s] / sum(weight[x] for x in names if x not in fixed) for s in names}
        above = {s for s in names if s not in fixed and share[s] > 3 * size[s]}
        if not above:
            break
        fixed |= above
    for s in names:
        assert abs(target[s] - share[s]) < 1e-6 and abs(taken[s] - share[s]) <= 20


def test_mixing_small_buckets_agree(spark):
    rows = [(i, "w " * (1 + i % 9), "en", f"s{i % 3}") for i in range(500)]
    plans = [{(r["doc_id"], r["copies"]) for r in mixing.plan(docs(spark, rows), bucket_rows=b).collect()} for b in (10, 50_000)]
    assert plans[0] == plans[1]


def test_mixed_rows(spark):
    rows = [(i, "w " * (1 + i % 9), "en", f"s{i % 3}") for i in range(60)]
    copies = {r["doc_id"]: r["copies"] for r in mixing.plan(docs(spark, rows)).collect()}
    got = defaultdict(int)
    for r in mixing.mixed(docs(spark, rows)).collect():
        got[r["doc_id"]] += 1
    assert dict(got) == {d: c for d, c in copies.items() if c}


# language

def test_language_accuracy(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.learn_and_predict(df).filter("held_out").select("row.lang", "lang_pred", "score").collect()
    assert np.mean([r[0] == r[1] for r in got]) > 0.97 and all(0 <= r[2] <= 1 for r in got)


def test_language_edges(spark):
    rows = [(i, "the house and the tree" if i % 2 else "der Baum und das Haus", "en" if i % 2 else "de") for i in range(40)]
    rows += [(50, None), (51, ""), (52, "123 ½ !?"), (53, "x", None), (None, "the house", None), (54, "und der Baum " * 20000, None)]
    got = {r[0]: (r[1], r[2]) for r in language_id.learn_and_predict(docs(spark, rows)).select("row.doc_id", "lang_pred", "score").collect()}
    assert got[50] == got[51] == got[52] == ("und", 0.0) and got[53][0] in ("en", "de") and got[54][0] == "de" and got[1][0] == "en"
    none = language_id.learn_and_predict(docs(spark, [(1, "text", None)]).withColumn("lang", F.lit(None).cast("string")))
    assert none.select("lang_pred", "score").collect()[0][:] == ("und", 0.0)
    one = language_id.learn_and_predict(docs(spark, [(1, "text", "en"), (3, "more", "en")]))
    assert {r[0] for r in one.select("lang_pred").collect()} == {"en"}


@pytest.mark.parametrize("per_language", [100, 5])
def test_language_of_null_and_repeated_ids(spark, per_language):
    words = {"en": "the and of house tree with".split(), "de": "der und das haus baum mit".split()}
    rng = np.random.default_rng(7)
    rows = [(None, " ".join(rng.choice(words[lang], 9)), lang) for lang in ("en", "de") * 300]
    rows += [(None, "the same text of a house", "en")] * 300 + [(5, "der gleiche text und das haus", "de")] * 300
    got = language_id.learn_and_predict(docs(spark, rows), per_language).select("row.lang", "lang_pred").collect()
    assert len(got) == 1200 and np.mean([a == b for a, b in got]) > 0.99
    copies = language_id.learn_and_predict(docs(spark, [(None, "the same", "en")] * 50 + [(None, "das gleiche", "de")] * 50), 3).select("row.lang", "lang_pred").collect()
    assert all(a == b for a, b in copies)


def test_pipeline_drops_unlearned_languages_and_junk(spark):
    import corpus_pipeline

    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rng = np.random.default_rng(5)
    junk = [" ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(30)) for _ in range(4)]
    other = ["Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan.", "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw.",
             "Все люди рождаются свободными и равными в своем достоинстве и правах."]
    added = docs(spark, [(10**7 + i, t, None) for i, t in enumerate(junk + other)]).select([F.col(c).cast(t).alias(c) for c, t in df.dtypes])
    kept = [r[0] for r in corpus_pipeline.identify_language(spark, df.unionByName(added), SF).select("doc_id").collect()]
    clean = df.filter(F.col("text").rlike("[A-Za-z]")).groupBy("lang").agg(F.count_if(F.col("doc_id").isin(kept)), F.count(F.lit(1))).collect()
    assert max(kept) < 10**7
    assert len(clean) == 4 and all(n >= 0.995 * total for _, n, total in clean)


def test_several_languages_in_a_family(spark):
    words = {"en": "the and of house", "de": "der und das haus", "nl": "het en van huis", "xx": "zork blip quux"}
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.choice(words[lang].split(), 12)), lang) for i, lang in enumerate(["en", "de", "nl", "xx"] * 30)]
    got = language_id.learn_and_predict(docs(spark, rows)).select("row.lang", "lang_pred").collect()
    assert all(r[0] == r[1] for r in got)


# chat

def chats_brute(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        convs[c].append(((turn is not None, turn or 0), (role is not None, role or ""), (text is not None, text or ""), role, text))
    seq = {c: tuple((x[3], x[4]) for x in sorted(v, key=lambda x: x[:3])) for c, v in convs.items()}
    order = lambda c: (c is None, c or 0)
    out = []
    for s in set(seq.values()):
        if any(len(o) > len(s) and o[:len(s)] == s for o in seq.values()):
            continue
        same = [c for c in seq if seq[c] == s]
        out.append((min(same, key=order), len(s), len(same), "".join(f"<|{r or ''}|>\n{t or ''}\n<|end|>\n" for r, t in s)))
    return sorted(out, key=str)


def test_chat(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "bot", "yo"), (2, 0, "user", "hi"), (3, 0, "user", "hi"), (3, 1, "bot", "yo"), (3, 2, "user", "bye"), (4, 0, None, "a"),
            (5, 0, "a", None), (6, None, "user", ""), (7, 1, "bot", "yo"), (7, 0, "user", "hi"), (7, 2, "user", "bye"), (None, 0, "user", "alone"), (8, 0, "user", "hi"), (8, 0, "user", "hi")]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, h1 int, turns string")
    assert sorted((tuple(r) for r in chat.format_chats(df).collect()), key=str) == chats_brute(rows)


# empty tables

def test_empty_tables(spark):
    none = docs(spark, [])
    vec = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert line_dedup.dedup_lines(none).count() == repeats.remove_repeats(none).count() == near_dedup.near_duplicates(none).count() == 0
    assert packing.pack_documents(none).count() == mixing.taken_words(none).count() == mixing.mixed(none).count() == 0
    assert language_id.learn_and_predict(none).count() == near_dedup.keep_one(none).count() == 0
    assert exact_topk.search(vec, F.col("vec_id") % 20 == 0).count() == ann.search(vec, F.col("vec_id") % 20 == 0).count() == 0
    assert url_rules.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_word_cache_gives_the_ids_of_whole_texts(monkeypatch):
    """Words looked up one by one, with a cache that fills up often, against the tokenizer on the whole text."""
    rng = random.Random(9)
    monkeypatch.setattr(packing, "CACHE_WORDS", 50)
    words = packing.WordCache(packing.tokenizer_path())
    alphabets = ["abcXYZ ,.'", "don't'll've 're'd'm's", "0123456789ab-_. ", "éàçßÿøÆÐđŁłńžğıſŉƒǅǆɏ abc", "<|endoftext|> a",
                 "\x00\x01\x7f\x85\xa0\xad a1'", "²³¼ªº·¬ab ", "中文字 あア한 a", "𝔘𐐀😀👍🏽 a", "é̀ ö", "ΣςİIi \x1c"]
    for i in range(6_000):
        text = "".join(rng.choice(alphabets[i % len(alphabets)]) for _ in range(rng.randint(0, 24)))
        assert words.encode(text) == words.whole(text), text
