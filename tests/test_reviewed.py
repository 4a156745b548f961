"""Cases from reviews: values next to a half, copies, sums and counts beyond a long, plans that move or repeat too much."""

import hashlib
import os

import duckdb  # noqa: F401  (check.duck needs it)
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import check
from evalspark.operators import fusion as U
from evalspark.operators import signatures as S

SMALL = "/root/testdata/sf0.001"


def same_as_sql(spark, folder, name):
    df, con = entry.queries()[name](spark, str(folder)), check.duck(str(folder))
    cur = con.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    got, want = check.rows_of(df.columns, [tuple(r) for r in df.collect()]), check.rows_of(cols, cur.fetchall())
    assert got == want and got


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def suppliers(spark, tmp_path_factory):
    """Reference values next to a half of the fourth digit and below 0.001, some rows twice under other keys."""
    folder = tmp_path_factory.mktemp("suppliers")
    for t in check.TABLES:
        if t != "supplier":
            os.symlink(f"{SMALL}/{t}.parquet", folder / f"{t}.parquet")
    rows = [(i, f"Supplier#{5000 + (i if k % 3 else -i):09d}", k % 4, x) for k in range(1500)
            for i, x in ((3 * k, round(0.4 * k + 0.2, 2)), (3 * k + 1, round(0.4 * k + 0.3, 2)))]
    rows += [(6000 + r[0], *r[1:]) for r in rows if r[0] % 2 == 0]
    con = check.duck(SMALL)
    con.execute("CREATE TABLE s (s_suppkey BIGINT, s_name VARCHAR, s_nationkey INTEGER, s_acctbal DOUBLE)")
    con.executemany("INSERT INTO s VALUES (?, ?, ?, ?)", rows)
    con.execute(f"COPY s TO '{folder}/supplier.parquet'")
    return folder


def test_sum_of_digests_goes_beyond_a_long(spark):
    n = 70_000
    got = S.order_free_signature(spark.range(n).withColumn("k", F.lit(1)), ["k"], [F.col("id").cast("string")]).first()
    h = [int(hashlib.sha1(str(i).encode()).hexdigest()[:12], 16) for i in range(n)]
    want = sum(h) % 2**64
    assert sum(h) >= 2**63 and got.sig_sum == (want - 2**64 if want >= 2**63 else want)
    assert got.n_rows == n


def test_subset_total_is_exact_and_null_beyond_a_long(spark):
    got = {r.n: r.s for r in spark.range(1, 130).select(F.col("id").alias("n"), U.subset_total("id").alias("s")).collect()}
    assert all(got[n] == (2**n - 1 - n if n < 63 else None) for n in got)


def test_reference_values_round_and_print_as_in_sql(spark, suppliers):
    same_as_sql(spark, suppliers, "g2_combine_reference_frames")


def test_ranks_of_values_next_to_a_half(spark, suppliers):
    same_as_sql(spark, suppliers, "e8_fill_missing_ranks")


def test_leaderboard_columns_of_small_values(spark, suppliers):
    same_as_sql(spark, suppliers, "k17_metrics_with_leaderboard_columns")


def test_equal_entries_of_a_list_all_stay(spark, suppliers):
    same_as_sql(spark, suppliers, "a17_reference_cache_bootstrap")


def test_names_in_both_splits_come_from_one_aggregate(spark):
    plan = plan_of(entry.queries()["g3_names_in_both"](spark, SMALL))
    assert "Join" not in plan and plan.count("Relation") == 1


def below_the_counts(spark, name):
    return plan_of(entry.queries()[name](spark, SMALL)).split("+-", 1)[1]


@pytest.mark.parametrize("name", ["b7_metric_names_of_runs", "b8_metric_names_of_leaderboards"])
def test_name_rules_run_once_a_spelling(spark, name):
    assert "CASE WHEN" not in below_the_counts(spark, name)


def test_direction_rules_run_once_a_spelling(spark):
    assert "CASE WHEN" not in below_the_counts(spark, "b9_metric_direction")


def test_float_text_rounds_the_exact_value(spark):
    """Next to a half of the twelfth digit the exact double decides, not its shortest text."""
    from evalspark.functions.cleaning import stable_float_text

    x = [1.0 + (10 * k + 5) / 1e12 for k in range(300)] + [0.0, -0.0, 1e-5, 123456.75, 1e300, float("inf"), float("nan"), None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i int, x double").withColumn("t", stable_float_text("x"))
    got = {r.i: r.t for r in df.collect()}
    assert [got[i] for i in range(302 + 3)] == [f"{v + 0.0:.12g}" for v in x[:305]]
    assert [got[i] for i in range(305, 308)] == ["nan"] * 3


def test_nearest_rows_match_brute_force_in_bounded_memory():
    import tracemalloc

    import numpy as np

    from evalspark.operators import neighbours as N

    rng = np.random.default_rng(3)
    b = np.round(rng.normal(size=(3000, 8)), 1)
    b[1000:1400] = b[7]
    a = np.concatenate([b[:40], rng.normal(size=(40, 8)), [[np.nan] * 8]])
    mine, other, dist = N._nearest(a, b, 5)
    want = N._distances(a, b)
    order = np.argsort(want, axis=1, kind="stable")[:, :5]
    assert (other.reshape(-1, 5) == order).all() and (mine == np.repeat(np.arange(81), 5)).all()
    np.testing.assert_allclose(dist, np.take_along_axis(want, order, 1).ravel())
    q, t = rng.normal(size=(2048, 64)), rng.normal(size=(20_000, 64))
    tracemalloc.start()
    N._nearest(q, t, 3)
    assert tracemalloc.get_traced_memory()[1] < 200e6  # the distances of all pairs alone would take 328 MB
    tracemalloc.stop()


def test_least_evidence_counts_every_labelled_row(spark):
    """A hundredth of the rows decides: with 5,000 rows of a language a sample of a fifth gives another value."""
    import numpy as np

    from evalspark.llm import language_id as L

    rng = np.random.default_rng(2)
    words = {"en": ["the", "house", "with", "there"], "de": ["das", "haus", "und", "nicht"]}
    rows = [(i, " ".join(rng.choice(words[lang], 6)) + " " + "".join(rng.choice(list("qxzjvkw"), i % 90)), lang) for i, lang in enumerate(["en", "de"] * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = L.fit(docs.filter("doc_id < 200"))
    got = L.least_evidence(docs.filter("doc_id >= 200"), model)
    seen = L.predict(docs.filter("doc_id >= 200"), model).filter("lang_pred = row.lang").select("lang_pred", "evidence").toPandas()
    want = seen.groupby("lang_pred").evidence.quantile(1 - L.CLEAN) / 2
    assert set(got) == set(want.index) == {"en", "de"}
    for lang, m in got.items():
        assert m == pytest.approx(want[lang], rel=1e-12)


def test_metric_rows_are_made_once(spark):
    df = entry.queries()["k8_tuned_models_from_reference"](spark, SMALL)
    assert "lineitem" not in df._jdf.queryExecution().simpleString() and df.count()


def shuffled_rows(spark):
    store = spark._jsparkSession.sparkContext().statusStore()
    stages = store.stageList(None, *[getattr(store, f"stageList$default${i}")() for i in range(2, 6)])
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_rows_no_pivot_parts_travel_once_a_block(spark):
    import numpy as np

    from evalspark.operators import neighbours as N

    x = np.random.default_rng(5).normal(size=(1500, 64))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").localCheckpoint()
    before = shuffled_rows(spark)
    got = N.nearest_neighbours(rows, rows, "id", "id", "v", 3).toPandas()
    assert shuffled_rows(spark) - before < 20_000  # 32 cells would send 48,000 rows
    want = np.argsort(N._distances(x, x), axis=1, kind="stable")[:, :3]
    assert (got.sort_values(["id", "neighbour_rank"]).neighbour_id.to_numpy().reshape(-1, 3) == want).all()


def test_single_precision_never_decides():
    """Far from zero, far apart, next to nothing, copies and rows without a number: as by plain differences."""
    import numpy as np

    from evalspark.operators import neighbours as N

    rng = np.random.default_rng(6)
    a, b = rng.normal(size=(60, 16)), rng.normal(size=(2000, 16))
    copies = np.repeat(rng.normal(size=(9, 16)), 300, axis=0)
    cases = [(a, b), (a + 1e6, b + 1e6), (a * 1e20, b * 1e20), (a * 1e-20, b * 1e-20), (a * 1e-30, b * 1e-30),
             (copies[::50], copies), (np.vstack([a, np.full((1, 16), np.nan)]), b), (a * 0, b * 0)]
    for x, y in cases:
        _, other, dist = N._nearest(x, y, 5)
        want = N._distances(x, y)
        order = np.argsort(want, axis=1, kind="stable")[:, :5]
        assert (other.reshape(-1, 5) == order).all()
        np.testing.assert_array_equal(dist, np.take_along_axis(want, order, 1).ravel())


def test_hashed_counts_leave_their_task_without_an_aggregate(spark):
    df = entry.queries()["j9_hashed_count_features"](spark, SMALL)
    assert "Aggregate" not in plan_of(df) and df.count()


def test_hashed_counts_sum_rows_of_one_key(spark):
    from collections import Counter

    from evalspark.operators import features as X

    texts = [(1, "a b a b"), (2, "x  y z"), (1, "b a b"), (None, "p q"), (None, "p q r"), (3, "one"), (4, None), (5, ""), (6, "m n " * 3000)]
    df = spark.createDataFrame(texts, "k long, text string").repartition(4)
    want = Counter()
    for k, t in texts:
        w = (t or "").split()
        for a, b in zip(w, w[1:]):
            want[k, int(hashlib.sha1(f"{a} {b}".encode()).hexdigest()[:12], 16) % 16] += 1
    got = X.hashed_counts(df, ["k"], X.token_ngrams("text", 2), 16).collect()
    assert len(got) == len(want) and {(r.k, r.bit): r.n for r in got} == want


def test_pattern_of_predictions_runs_once_an_event(spark):
    from evalspark.plans import views as V

    assert plan_of(V.v_pred(spark, SMALL)).count("regexp_extract(") == 1


def test_written_out_sum_equals_the_lambda(spark):
    rows = [([0.1, 0.2, 0.7], [3.0, 1e9, -2.5]), ([0.5], [7.0]), ([], []), ([0.5, 0.5], [1.0, None])]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    both = df.select(U._dot("a", "b").alias("x"), U._short_dot(F.col("a"), F.col("b"), 3).alias("y"))
    assert all(r.x == r.y for r in both.collect())
    assert "lambda" not in plan_of(both.select("y"))
