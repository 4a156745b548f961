"""SimHash links, the filter audit and spelling variants against plain Python on small tables."""

import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from evalspark.llm import filter_audit, simhash, spelling
from tests.llm.test_brute_force import docs, hard_rows


# fingerprints

def print_brute(text, size):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i:i + size]), 42) for i in range(max(1, len(w) - size + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def smallest_reachable(values, linked):
    parent = list(range(len(values)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(values)), 2):
        if linked(values[i], values[j]):
            parent[find(i)] = find(j)
    return [find(i) for i in range(len(values))]


def components_brute(ids, prints, distance):
    roots = smallest_reachable(prints, lambda a, b: (a ^ b).bit_count() <= distance)
    least = defaultdict(list)
    for i, r in zip(ids, roots):
        if i is not None:
            least[r].append(i)
    return [min(least[r], default=None) for r in roots]


@pytest.mark.parametrize("size", [3, 5])
def test_simhash_documents(spark, size):
    rows = hard_rows() + [(None, None), (None, "only one"), (50, "A  B"), (51, "a b")]
    base = " ".join(f"w{i % 83}" for i in range(400))
    rows += [(60 + i, base + f" tail{i}") for i in range(12)]
    got = simhash.near_prints(docs(spark, rows).repartition(3), size, 2).select("doc_id", "fingerprint", "component_id").collect()
    prints = [print_brute(r[1], size) for r in rows]
    want = [(r[0], f"{p:016x}", c) for r, p, c in zip(rows, prints, components_brute([r[0] for r in rows], prints, 2))]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def _random_prints(seed):
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(12)] + [0]
    out = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(6))) for c in centres for _ in range(60)}
    out |= {centres[0] & ~0xFFFFF | i for i in range(300)}  # 44 equal bits: a crowded value of every partition that holds only those
    return sorted(out)


@pytest.mark.parametrize("distance,bucket", [(2, 2048), (2, 16), (1, 8), (3, 32)])
def test_links_of_prints(spark, distance, bucket):
    values = _random_prints(distance)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "print long").repartition(3)
    links = simhash.links(df, distance, bucket=bucket).collect()
    joined = smallest_reachable(values, lambda a, b: (a ^ b).bit_count() <= distance)
    place = {v: i for i, v in enumerate(signed)}
    assert all(joined[place[a]] == joined[place[b]] for a, b in links)
    near = {frozenset((place[a], place[b])) for a, b in links}
    again = smallest_reachable(list(range(len(values))), lambda a, b: frozenset((a, b)) in near)
    assert len(set(again)) == len(set(joined))
    if bucket == 2048:
        assert len(links) <= 3 * 34 * len(values)  # a forest per bucket, not its pairs


def test_thresholds_keep_the_principle():
    values = np.array(_random_prints(7), np.uint64)
    both = simhash._both_set(values).reshape(64, 64)
    groups = simhash.group_bits(both, len(values), 3)
    assert sorted(b for g in groups for b in g) == list(range(64))
    halves = simhash._halves(groups)
    room = 1 << max(map(len, halves))
    counts = simhash._half_values(halves, room)(values).reshape(len(halves), room)
    chosen = simhash.Allocation(groups, counts, len(values), 2).thresholds(values)
    assert (chosen >= -1).all() and (chosen.sum(axis=1) == 2 - 3 + 1).all()
    assert len({tuple(r) for r in chosen}) > 1  # unequal, and not the same for all


def test_simhash_empty_table(spark):
    out = simhash.near_prints(docs(spark, []), 3, 2)
    assert out.count() == 0 and "component_id" in out.columns


# filter audit

def audit_brute(rows, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    first = {}
    for d, t, *_ in rows:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    cell = defaultdict(list)
    for d, t, _, source in rows:
        t = t or ""
        w = filter_words(t)
        caps = sum("A" <= c <= "Z" for c in t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * caps > 5 * len(t), "D": any(c in t for c in "#$%&*|"),
                 "E": d is not None and d > first[t]}
        cell[source or ""].append((frozenset(k for k, v in fails.items() if v), d in good, d in toxic))
    out = []
    for part, found in cell.items():
        by = {}
        for order in map("".join, itertools.permutations("ABCDE")):
            for s, f in enumerate(order, 1):
                here = [x for x in found if f in x[0] and not x[0] & set(order[:s - 1])]
                by[order, s] = (sum(not x[0] & set(order[:s]) for x in found), len(here), sum(f in x[0] for x in found) - len(here), sum(x[0] == {f} for x in found),
                                sum(x[1] for x in here), sum(x[2] for x in here))
        total = Counter()
        for (order, s), v in by.items():
            total[order[s - 1]] += v[1]
        out += [(part, order, s, *v, total[order[s - 1]]) for (order, s), v in by.items()]
    return sorted(out)


def filter_words(text):
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def test_filter_audit(spark):
    rows = [(r[0], r[1], "en", ["s", None, "", "Other"][i % 4]) for i, r in enumerate(hard_rows())]
    rows += [(70 + i, "Same TEXT # twice " * 20, "en", "hot") for i in range(5)] + [(70, "Same TEXT # twice " * 20, "en", "s"), (None, "Same TEXT # twice " * 20, "en", "hot"), (None, None, None, None)]
    labels = [(70, 1, 0), (70, 0, 1), (71, 1, 1), (72, None, None), (None, 1, 1), (3, 1, 0), (999, 1, 1)]
    out = filter_audit.audit(docs(spark, rows).repartition(4), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    cols = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(tuple(r) for r in out.select(*cols).collect()) == audit_brute(rows, labels)


def test_filter_audit_empty_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs(spark, []), labels).count() == 0
    out = filter_audit.audit(docs(spark, [(1, "x")]), labels).collect()
    assert len(out) == 600 and {r["removed"] for r in out if r["step"] == 1 and r["filter_order"][0] == "A"} == {1}


# spelling

def one_edit_apart(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def spelling_brute(rows, every=31):
    lower = {c: c + 32 for c in range(65, 91)}
    n = Counter()
    for d, t, *_ in rows:
        for run in "".join(c if c.isascii() and c.isalpha() or "À" <= c <= "ÿ" else " " for c in t or "").split(" "):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if run and h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    words = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    near = {w: [u for u in words if one_edit_apart(w, u)] for w in words}
    form = {}
    for w, us in near.items():
        best = min(us, key=lambda u: (-words[u], u), default=None)
        form[w] = best if best and words[best] >= 10 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, words[w], len(near[w]), form[w], words.get(form[w]), root))
    return sorted(out)


def spelling_rows():
    rng = random.Random(3)
    rows = []
    for i, word in enumerate(["abababab", "aaaaaaaa", "Élégance", "strasseß", "mississippi", "parallel", "x" * 40, "×÷multiply"]):
        forms = [word] + [word[:k] + rng.choice("abcé") + word[k + rng.randrange(2):] for k in range(len(word))] + [word[:k] + word[k + 1:] for k in range(len(word))]
        for k, f in enumerate(forms):
            rows.append((i * 100 + k, " ".join([f] * (400 if k == 0 else 30 if k == 1 else 1 + rng.randrange(4)))))
    rows += [(9000, "chainword " * 400), (9001, "chainwore " * 30), (9002, "chainwxre " * 2)]
    return rows + [(None, None), (None, "Mississippi mississippi"), (1, ""), (1, "PARALLEL-parallel_parallelİparallel"), (2, "aaaaaaaa" * 400), (3, "aaaaaaaa" * 400 + " b"), (4, "short words only")]


@pytest.mark.parametrize("shard", [8192, 8])
def test_spelling_variants(spark, shard):
    rows = spelling_rows()
    out = spelling.spelling_variants(docs(spark, rows).repartition(3), shard=shard).select("word", "n", "n_near", "form", "form_n", "root")
    want = spelling_brute(rows)
    assert sorted(tuple(r) for r in out.collect()) == want
    assert any(w[3] for w in want) and any(w[5] != w[3] for w in want if w[3])  # forms, and a chain of them


def test_spelling_empty_table(spark):
    assert spelling.spelling_variants(docs(spark, []), shard=8).count() == 0


@pytest.mark.parametrize("letters,longest", [("ab", 11), ("abcé", 8)])
def test_search_scheme_finds_each_word_once(letters, longest):
    rng = random.Random(longest)
    words = sorted({"".join(rng.choice(letters) for _ in range(rng.randrange(7, longest + 1))) for _ in range(600)})
    index = spelling.FmIndex(words)
    asks = words + ["zzzzzzzz", letters[0] * 9]
    exact = np.array([len(w) // 2 for w in asks])
    q, u = spelling.one_edit(index, asks, exact)
    got = sorted((asks[a], words[b]) for a, b in zip(q, u))
    assert got == sorted((a, b) for a in asks for b in words if one_edit_apart(a, b) and b.startswith(a[:len(a) // 2])) and got
