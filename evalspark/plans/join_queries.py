"""Joins, windows, sorts, set operations and signatures."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from evalspark.functions import cleaning as C
from evalspark.functions import taxonomy as T
from evalspark.operators import joins as J
from evalspark.operators import metrics as M
from evalspark.operators import ordering as O
from evalspark.operators import reports as R
from evalspark.operators import signatures as S
from evalspark.plans import views as V
from evalspark.plans.registry import query, r, rounded
from evalspark.session import durable
from evalspark.plans.report_queries import RD, REFK, VA, VM, refs

VP = ("v_pred",)


@query("c1_occurrence_join", """
WITH x AS (SELECT dataset, entity_key, row_id, row_number() OVER (PARTITION BY dataset, entity_key ORDER BY row_id) - 1 AS occurrence
 FROM v_pred WHERE model = 'm_lin'),
y AS (SELECT dataset, entity_key, predicted, row_number() OVER (PARTITION BY dataset, entity_key ORDER BY -row_id) - 1 AS occurrence
 FROM v_pred WHERE model = 'm_k' AND NOT (dataset = 'click' AND predicted = 7)),
j AS (SELECT x.*, y.predicted FROM x LEFT JOIN y USING (dataset, entity_key, occurrence))
SELECT dataset, entity_key, row_id, occurrence, predicted, count(*) FILTER (predicted IS NULL) OVER (PARTITION BY dataset) = 0 AS aligned FROM j""", VP)
def c1(spark, d):
    p = V.v_pred(spark, d)
    want = p.where("model = 'm_lin'").select("dataset", "entity_key", F.col("row_id").alias("seq"))
    have = p.where("model = 'm_k' AND NOT (dataset = 'click' AND predicted = 7)").select(
        "dataset", "entity_key", (-F.col("row_id")).alias("seq"), "predicted")
    out = J.occurrence_align(want, have, ["dataset"], "entity_key", "seq", "predicted")
    return out.select("dataset", "entity_key", F.col("seq").alias("row_id"), "occurrence", "predicted", "aligned")


@query("c2_alignment_fallbacks", """
WITH x AS (SELECT event_type AS dataset, user_id, event_id FROM events),
y AS (SELECT event_type AS dataset, user_id, CASE WHEN event_type = 'view' THEN -event_id ELSE event_id END AS seq FROM events
 WHERE NOT (event_type = 'click' AND value > 100) AND NOT (event_type = 'error' AND event_id > 5000)),
a AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY event_id) AS i FROM x),
b AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY seq) AS i FROM y),
p AS (SELECT a.dataset, count(*) AS n_expected, count(b.i) AS shared, count(*) FILTER (b.i IS NOT NULL AND a.user_id <> b.user_id) AS wrong
 FROM a LEFT JOIN b USING (dataset, i) GROUP BY a.dataset),
n AS (SELECT dataset, count(*) AS n_actual FROM y GROUP BY dataset),
c AS (SELECT dataset, user_id, count(*) AS na FROM x GROUP BY ALL), e AS (SELECT dataset, user_id, count(*) AS nb FROM y GROUP BY ALL),
s AS (SELECT c.dataset, count(*) FILTER (coalesce(nb, 0) < na) AS short FROM c LEFT JOIN e USING (dataset, user_id) GROUP BY c.dataset)
SELECT p.dataset, n_expected, n_actual, CASE WHEN wrong = 0 AND n_expected = n_actual THEN 'exact' WHEN short = 0 THEN 'occurrence'
 WHEN wrong = 0 AND shared > 0 THEN 'prefix' ELSE 'clip' END AS mode FROM p JOIN n USING (dataset) JOIN s USING (dataset)""")
def c2(spark, d):
    e = V.table(spark, d, "events").select(F.col("event_type").alias("dataset"), "user_id", F.col("event_id").alias("seq"), "value")
    other = e.where(~((F.col("dataset") == "click") & (F.col("value") > 100))
                    & ~((F.col("dataset") == "error") & (F.col("seq") > 5000)))
    other = other.withColumn("seq", F.when(F.col("dataset") == "view", -F.col("seq")).otherwise(F.col("seq")))
    return J.alignment_mode(e, other, ["dataset"], "user_id", "seq")


@query("c3_multiway_alignment", """
SELECT dataset, split, row_id, entity_key, max(observed) AS observed, max(predicted) FILTER (model = 'm_k') AS m_k,
 round(max(predicted) FILTER (model = 'm_lin'), 6) AS m_lin, max(predicted) FILTER (model = 'm_gap') AS m_gap
FROM v_pred GROUP BY ALL HAVING count(DISTINCT model) = 3""", VP)
def c3(spark, d):
    a = J.aligned_predictions(V.v_pred(spark, d), ["dataset", "split"], ["row_id", "entity_key"], "observed")
    p = F.col("predictions")
    return a.select("dataset", "split", "row_id", "entity_key", "observed", p["m_k"].alias("m_k"), r(p["m_lin"]).alias("m_lin"),
                    p["m_gap"].alias("m_gap"))


def run_side(spark, d, name):
    return V.v_runs(spark, d).where(F.col("run_name") == name).drop("run_name")


@query("c4_run_diff", """
WITH a AS (SELECT * FROM v_runs WHERE run_name = 'run_F' AND dataset <> '1-URGENT'), b AS (SELECT * FROM v_runs WHERE run_name = 'run_O' AND dataset <> '5-LOW')
SELECT coalesce(a.dataset, b.dataset) AS dataset, a.n_rows AS n_rows_current, b.n_rows AS n_rows_reference, a.n_keys AS n_keys_current,
 b.n_keys AS n_keys_reference, a.n_rows IS NOT DISTINCT FROM b.n_rows AS n_rows_match, a.n_keys IS NOT DISTINCT FROM b.n_keys AS n_keys_match,
 a.n_rows IS NOT DISTINCT FROM b.n_rows AND a.n_keys IS NOT DISTINCT FROM b.n_keys AS all_match
FROM a FULL JOIN b ON a.dataset = b.dataset""", ("v_runs",))
def c4(spark, d):
    a = run_side(spark, d, "run_F").where("dataset <> '1-URGENT'")
    b = run_side(spark, d, "run_O").where("dataset <> '5-LOW'")
    return J.full_outer_diff(a, b, ["dataset"], ["n_rows", "n_keys"])


@query("c5_error_diff", """
WITH a AS (SELECT dataset, model, workflow, coalesce(error, '') AS e FROM v_metrics WHERE run_name = 'run_F'),
b AS (SELECT dataset, model, workflow, coalesce(CASE WHEN model = 'KNN' THEN 'crash' ELSE error END, '') AS e FROM v_metrics WHERE run_name = 'run_O'),
j AS (SELECT coalesce(a.dataset, b.dataset) AS dataset, coalesce(a.model, b.model) AS model, coalesce(a.e, '') AS ce, coalesce(b.e, '') AS re
 FROM a FULL JOIN b ON a.dataset = b.dataset AND a.model = b.model),
c AS (SELECT *, CASE WHEN ce NOT IN ('', 'nan', 'none') THEN ce END AS q, CASE WHEN re NOT IN ('', 'nan', 'none') THEN re END AS p FROM j)
SELECT dataset, model, CASE WHEN p IS NULL AND q IS NULL THEN 'ok_both' WHEN p IS NULL THEN 'new_error' WHEN q IS NULL THEN 'resolved'
 WHEN p = q THEN 'persistent_same' ELSE 'changed_error' END AS transition, count(*) AS n_rows FROM c GROUP BY ALL""", VM)
def c5(spark, d):
    m = V.v_metrics(spark, d)
    other = m.where("run_name = 'run_O'").withColumn("error", F.when(F.col("model") == "KNN", "crash").otherwise(F.col("error")))
    out = J.error_diff(m.where("run_name = 'run_F'"), other)
    return out.groupBy("dataset", "model", "transition").agg(F.count(F.lit(1)).alias("n_rows"))


def config_of(df):
    pairs = F.array(*[F.struct(F.concat(F.col("dataset"), F.lit("." + c)).alias("config_key"), F.col(c).cast("string").alias("value"))
                      for c in ("n_rows", "n_keys", "first_key")])
    return df.select(F.explode(pairs).alias("p")).select("p.*")


@query("c6_config_diff", """
WITH u AS (SELECT run_name, concat(dataset, '.', k) AS config_key, v AS value FROM (SELECT run_name, dataset, CAST(n_rows AS VARCHAR) AS n_rows,
  CAST(n_keys AS VARCHAR) AS n_keys, CAST(first_key AS VARCHAR) AS first_key FROM v_runs) UNPIVOT (v FOR k IN (n_rows, n_keys, first_key))),
a AS (SELECT * FROM u WHERE run_name = 'run_F' AND config_key NOT LIKE '1-%'), b AS (SELECT * FROM u WHERE run_name = 'run_O')
SELECT coalesce(a.config_key, b.config_key) AS config_key, coalesce(a.value, '') AS current_value, coalesce(b.value, '') AS reference_value,
 coalesce(a.value, '') <> coalesce(b.value, '') AS different FROM a FULL JOIN b ON a.config_key = b.config_key""", ("v_runs",))
def c6(spark, d):
    return J.config_diff(config_of(run_side(spark, d, "run_F")).where(~F.col("config_key").startswith("1-")),
                         config_of(run_side(spark, d, "run_O")))


@query("c7_best_vs_reference_best", f"""
WITH b AS (SELECT run_name, dataset, arg_min(model, (CASE WHEN primary_metric = 'RMSE' THEN primary_metric_value ELSE -primary_metric_value END, model, attempt)) AS model,
  min(CASE WHEN primary_metric = 'RMSE' THEN primary_metric_value ELSE -primary_metric_value END) AS s,
  max(CASE primary_metric WHEN 'RMSE' THEN 'rmse' WHEN 'ROC-AUC' THEN 'roc_auc' ELSE 'spearman' END) AS kind
  FROM v_metrics WHERE error IS NULL OR error = 'nan' GROUP BY run_name, dataset),
f AS (SELECT dataset, max({REFK}) AS ref_kind FROM v_ref GROUP BY dataset)
SELECT a.dataset, a.model AS current_best_model, b.model AS reference_best_model, round(abs(a.s) - abs(b.s), 6) AS current_minus_reference,
 coalesce(f.ref_kind = a.kind, false) AS leaderboard_comparable
FROM b a LEFT JOIN b ON b.dataset = a.dataset AND b.run_name = 'run_O' LEFT JOIN f ON f.dataset = a.dataset WHERE a.run_name = 'run_F'""",
       ("v_metrics", "v_ref"))
def c7(spark, d):
    best = R.best_rows(V.v_metrics(spark, d), RD, [F.col("model"), F.col("attempt")])
    a = best.where("run_name = 'run_F'").select("dataset", F.col("model").alias("current_best_model"), "primary_metric",
                                                F.col("primary_metric_value").alias("_a"))
    b = best.where("run_name = 'run_O'").select("dataset", F.col("model").alias("reference_best_model"),
                                                F.col("primary_metric_value").alias("_b"))
    f = refs(spark, d).groupBy("dataset").agg(F.max("kind").alias("_kind"))
    same = F.col("_kind") == T.normalize_metric("primary_metric")
    return a.join(b, "dataset", "left").join(f, "dataset", "left").select(
        "dataset", "current_best_model", "reference_best_model", r(F.col("_a") - F.col("_b")).alias("current_minus_reference"),
        F.coalesce(same, F.lit(False)).alias("leaderboard_comparable"))


@query("c8_rounded_key_lookup", """
WITH l AS (SELECT event_type, floor(value) AS v, min(event_id) AS first_id FROM events WHERE CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) < 50 GROUP BY ALL)
SELECT e.event_id, l.first_id FROM events e JOIN l ON l.event_type = e.event_type AND l.v = floor(e.value) WHERE CAST(regexp_extract(e.props, '([0-9]+)', 1) AS INT) >= 50""")
def c8(spark, d):
    e = V.table(spark, d, "events").select("event_id", "event_type", F.floor("value").cast("double").alias("value"),
                                           F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k"))
    lookup = e.where("k < 50").select("event_type", "value", F.col("event_id").alias("first_id"))
    return J.lookup_by_rounded_key(e.where("k >= 50").drop("k"), lookup, "event_type", "value", "first_id").select(
        "event_id", "first_id")


@query("c9_reference_with_fallback_key", """
WITH ref AS (SELECT n_nationkey AS id, n_name, n_regionkey FROM nation),
c AS (SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE CAST(c_nationkey AS VARCHAR) END AS id, concat(' nation_', CAST(c_nationkey AS VARCHAR)) AS nm FROM customer)
SELECT c_custkey, n_name, CASE WHEN c.id <> '' THEN 'first' ELSE 'second' END AS matched_by
FROM c JOIN ref ON CASE WHEN c.id <> '' THEN c.id = CAST(ref.id AS VARCHAR) ELSE lower(trim(nm)) = lower(n_name) END""")
def c9(spark, d):
    ref = V.table(spark, d, "nation")
    c = V.table(spark, d, "customer").select(
        "c_custkey", F.when(F.col("c_mktsegment") == "BUILDING", "").otherwise(F.col("c_nationkey").cast("string")).alias("benchmark_id"),
        F.concat(F.lit(" nation_"), F.col("c_nationkey").cast("string")).alias("dataset"))
    out = J.lookup_with_fallback(c, ref, ("benchmark_id", "n_nationkey"), ("dataset", "n_name"), ["n_name"])
    return out.select("c_custkey", "n_name", "matched_by")


@query("c11_pairwise_self_join", """
SELECT a.dataset, a.model AS model_a, b.model AS model_b, count(*) AS n_rows, round(avg(abs(a.predicted - b.predicted)), 6) AS mean_gap
FROM v_pred a JOIN v_pred b ON a.dataset = b.dataset AND a.row_id = b.row_id AND a.model < b.model GROUP BY ALL""", VP)
def c11(spark, d):
    p = J.model_pairs(V.v_pred(spark, d), ["dataset"], ["row_id"])
    return p.groupBy("dataset", "model_a", "model_b").agg(
        F.count(F.lit(1)).alias("n_rows"), r(F.avg(F.abs(F.col("value_a") - F.col("value_b")))).alias("mean_gap"))


@query("c12_rank_against_reference", f"""
WITH rf AS (SELECT dataset, {REFK} AS kind, metric_value_numeric AS v FROM v_ref),
m AS (SELECT run_name, dataset, model, attempt, primary_metric_value AS x, CASE primary_metric WHEN 'RMSE' THEN 'rmse' WHEN 'ROC-AUC' THEN 'roc_auc' ELSE 'spearman' END AS kind FROM v_metrics),
o AS (SELECT dataset, kind, v, row_number() OVER (PARTITION BY dataset ORDER BY CASE WHEN kind = 'rmse' THEN v ELSE -v END) AS i, count(*) OVER (PARTITION BY dataset) AS n FROM rf)
SELECT m.run_name, m.dataset, m.model, m.attempt, 1 + count(*) FILTER (CASE WHEN m.kind = 'rmse' THEN o.v < m.x ELSE o.v > m.x END) AS estimated_rank,
 count(*) FILTER (CASE WHEN m.kind = 'rmse' THEN o.v < m.x ELSE o.v > m.x END) < 10 AS in_top10,
 round(max(CASE WHEN i = 1 THEN CASE WHEN m.kind = 'rmse' THEN m.x - o.v ELSE o.v - m.x END END), 6) AS gap_to_best,
 round(max(CASE WHEN i = least(10, n) THEN CASE WHEN m.kind = 'rmse' THEN m.x - o.v ELSE o.v - m.x END END), 6) AS gap_to_tenth
FROM m JOIN o ON o.dataset = m.dataset AND o.kind = m.kind GROUP BY m.run_name, m.dataset, m.model, m.attempt""", ("v_metrics", "v_ref"))
def c12(spark, d):
    m = V.v_metrics(spark, d).select("run_name", "dataset", "model", "attempt", "primary_metric_value",
                                     T.leaderboard_metric_kind("primary_metric").alias("kind"))
    low = T.leaderboard_direction("kind") == "lower"
    m = durable(m.withColumn("score", T.comparison_score("primary_metric_value", low)))
    out = J.rank_against(m, R.reference_scores(refs(spark, d)), ["dataset", "kind"], "score", "model")
    return rounded(out.select("run_name", "dataset", "model", "attempt", "estimated_rank", "in_top10", "gap_to_best",
                              "gap_to_tenth"), "gap_to_best", "gap_to_tenth")


@query("c14_rows_with_known_key", """
SELECT doc_id, lang, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def c14(spark, d):
    docs = V.table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    return docs.join(V.table(spark, d, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi")


@query("c15_missing_models", """
SELECT n.n_name AS dataset, e.model FROM nation n CROSS JOIN (VALUES ('SVR'), ('XGBoost'), ('Stacked GP')) e(model)
WHERE NOT EXISTS (SELECT 1 FROM v_metrics m WHERE m.dataset = n.n_name AND m.model = e.model AND (m.error IS NULL OR m.error = 'nan') AND m.attempt = 'ECONOMY')""", VM)
def c15(spark, d):
    done = V.v_metrics(spark, d).where(~C.has_error("error") & (F.col("attempt") == "ECONOMY")).select("dataset", "model").distinct()
    want = spark.createDataFrame([("SVR",), ("XGBoost",), ("Stacked GP",)], "model string")
    datasets = V.table(spark, d, "nation").select(F.col("n_name").alias("dataset"))
    return J.missing_models(datasets, want, done)


@query("c16_validated_join", """
SELECT o_orderkey, c_custkey, c_nationkey FROM orders JOIN customer ON c_custkey = o_custkey""")
def c16(spark, d):
    o = V.table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), F.col("o_custkey").alias("k"))
    c = V.table(spark, d, "customer").select("c_custkey", "c_nationkey", F.col("c_custkey").alias("k2"))
    return J.validated_join(c, o, ["c_custkey"], "k", "k2").select("o_orderkey", "c_custkey", "c_nationkey")


@query("c17_dimension_join_drop_incomplete", """
SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
WHERE n_name <> 'NATION_3'""")
def c17(spark, d):
    dim = (V.table(spark, d, "nation").where("n_name <> 'NATION_3'")
           .join(V.table(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
           .select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "r_name").dropDuplicates())
    c = V.table(spark, d, "customer").select("c_custkey", "c_nationkey")
    return c.join(dim, "c_nationkey", "left").dropna(subset=["n_name", "r_name"]).select("c_custkey", "n_name", "r_name")


BESTM = """g AS (SELECT dataset, model, sqrt(avg((observed - predicted) ** 2)) AS rmse FROM v_pred WHERE split = 'test' GROUP BY ALL),
b AS (SELECT dataset, arg_min(model, (rmse, model)) AS model FROM g GROUP BY dataset)"""


def best_models(spark, d):
    g = V.v_pred(spark, d).where("split = 'test'").groupBy("dataset", "model").agg(M.rmse("observed", "predicted").alias("rmse"))
    return O.best_row(g, ["dataset"], [F.col("rmse"), F.col("model")]).select("dataset", "model")


@query("c18_best_model_predictions", f"""WITH {BESTM}
SELECT p.dataset, p.model, p.row_id, p.observed, round(p.predicted, 6) AS predicted FROM v_pred p JOIN b ON b.dataset = p.dataset AND b.model = p.model
WHERE p.split = 'test'""", VP)
def c18(spark, d):
    p = V.v_pred(spark, d).where("split = 'test'").select("dataset", "model", "row_id", "observed", r("predicted").alias("predicted"))
    return p.join(best_models(spark, d), ["dataset", "model"])


@query("c19_lookup_map", """
SELECT run_name, v.dataset, model, attempt, t.mx AS dataset_elapsed FROM v_metrics v
JOIN (SELECT dataset, max(elapsed_seconds) AS mx FROM v_metrics GROUP BY dataset) t ON t.dataset = v.dataset""", VM)
def c19(spark, d):
    m = V.v_metrics(spark, d)
    look = m.groupBy("dataset").agg(F.max("elapsed_seconds").alias("dataset_elapsed"))
    return m.select("run_name", "dataset", "model", "attempt").join(look, "dataset", "left")


@query("c20_dataset_profile", f"""
WITH a AS (SELECT dataset, sum(n_train) AS n_rows FROM v_analysis GROUP BY dataset),
w AS (SELECT dataset, arg_min(model, (score, model, run_name)) AS winning_model, min(score) AS best_score FROM v_analysis GROUP BY dataset),
f AS (SELECT dataset, max({REFK}) AS board_kind, count(*) AS board_rows FROM v_ref GROUP BY dataset),
c AS (SELECT n_name AS dataset, count(*) AS customers, round(avg(c_acctbal), 4) AS mean_balance FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name)
SELECT a.dataset, CAST(n_rows AS BIGINT) AS n_rows, winning_model, round(best_score, 6) AS best_score, board_kind, board_rows, customers, mean_balance
FROM a LEFT JOIN w USING (dataset) LEFT JOIN f USING (dataset) LEFT JOIN c USING (dataset)""", ("v_metrics", "v_analysis", "v_ref"))
def c20(spark, d):
    a = V.v_analysis(spark, d)
    facts = a.groupBy("dataset").agg(F.sum("n_train").alias("n_rows"))
    win = R.best_by_score(a, ["dataset"], tie=("model", "run_name")).select(
        "dataset", F.col("model").alias("winning_model"), r("comparison_score").alias("best_score"))
    board = refs(spark, d).groupBy("dataset").agg(F.max("kind").alias("board_kind"), F.count(F.lit(1)).alias("board_rows"))
    nation = V.table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("dataset"))
    cust = (V.table(spark, d, "customer").join(nation, "c_nationkey").groupBy("dataset")
            .agg(F.count(F.lit(1)).alias("customers"), r(F.avg("c_acctbal"), 4).alias("mean_balance")))
    return facts.join(win, "dataset", "left").join(board, "dataset", "left").join(cust, "dataset", "left")


@query("c21_selected_flag", """
WITH s AS (SELECT pos FROM v_long GROUP BY pos HAVING avg(x) > 0)
SELECT v.vec_id, v.pos, s.pos IS NOT NULL AS is_selected FROM v_long v LEFT JOIN s ON s.pos = v.pos""", ("v_long",))
def c21(spark, d):
    long = V.v_long(spark, d).select("vec_id", "pos", "x")
    chosen = long.groupBy("pos").agg(F.avg("x").alias("m")).where("m > 0").select("pos", F.lit(True).alias("_hit"))
    return long.join(chosen, "pos", "left").select("vec_id", "pos", F.col("_hit").isNotNull().alias("is_selected"))


# --- E: windows over report rows, and their skew-safe forms over raw rows ------------------------------------------

@query("e1_rank_ties_min", """
SELECT dataset, model, row_id, rank() OVER (PARTITION BY dataset, model ORDER BY abs(observed - predicted)) AS error_rank
FROM v_pred""", VP)
def e1(spark, d):
    p = V.v_pred(spark, d).select("dataset", "model", "row_id",
                                  F.abs(F.col("observed") - F.col("predicted")).alias("err"))
    k = O.ranks(p, ["dataset", "model"], "err").select("dataset", "model", "err", F.col("rank_min").alias("error_rank"))
    return O.key_join(p, k, ["dataset", "model", "err"]).drop("err")


PCT = "(rank() OVER (PARTITION BY run_name, dataset ORDER BY {v}) + (count(*) OVER (PARTITION BY run_name, dataset, {v}) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY run_name, dataset)"


@query("e2_percent_rank_average", f"""
SELECT run_name, dataset, model, round({PCT.format(v='delta')}, 6) AS performance_percentile,
 round({PCT.format(v='elapsed_seconds')}, 6) AS runtime_percentile,
 round(0.75 * {PCT.format(v='delta')} + 0.25 * {PCT.format(v='elapsed_seconds')}, 6) AS cost_performance_score FROM v_analysis""", VA)
def e2(spark, d):
    c = R.cost_performance(V.v_analysis(spark, d), RD)
    return rounded(c.select(*RD, "model", "performance_percentile", "runtime_percentile", "cost_performance_score"),
                   "performance_percentile", "runtime_percentile", "cost_performance_score")


@query("e4_lag_by_stage", """
WITH s AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)
SELECT user_id, event_type, n, n - lag(n) OVER (PARTITION BY user_id ORDER BY event_type) AS gain FROM s""")
def e4(spark, d):
    s = V.table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return s.withColumn("gain", F.col("n") - F.lag("n").over(Window.partitionBy("user_id").orderBy("event_type")))


@query("e5_occurrence_number", """
SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS occurrence FROM events""")
def e5(spark, d):
    e = V.table(spark, d, "events").select("event_id", "user_id", "ts")
    return O.row_numbers(e, ["user_id"], ["ts", "event_id"], "occurrence").drop("ts")


@query("e6_share_of_total", """
WITH s AS (SELECT event_type, user_id, sum(CASE WHEN event_type = 'error' THEN 0 ELSE value END) AS v FROM events GROUP BY ALL)
SELECT event_type, user_id, round(v / nullif(sum(v) OVER (PARTITION BY event_type), 0), 8) AS share FROM s""")
def e6(spark, d):
    v = F.when(F.col("event_type") == "error", 0.0).otherwise(F.col("value"))
    s = V.table(spark, d, "events").groupBy("event_type", "user_id").agg(F.sum(v).alias("v"))
    tot = s.groupBy("event_type").agg(F.sum("v").alias("t"))
    return s.join(tot, "event_type").select("event_type", "user_id", r(C.safe_ratio("v", "t"), 8).alias("share"))


@query("e7_delta_from_best", """
SELECT run_name, dataset, model, round(delta, 6) AS delta FROM v_analysis""", VA)
def e7(spark, d):
    return V.v_analysis(spark, d).select(*RD, "model", r("analysis_delta_from_best").alias("delta"))


@query("e8_fill_missing_ranks", """
WITH k AS (SELECT *, CASE WHEN reference_source = 'board' AND length(model) = 18 AND metric_value_numeric > 1.5 THEN 3 END AS rank_given FROM v_ref)
SELECT dataset, model, CAST(coalesce(rank_given, row_number() OVER (PARTITION BY dataset, leaderboard_metric_name, rank_given IS NULL ORDER BY
  CASE WHEN leaderboard_metric_name = 'RMSE' THEN metric_value_numeric ELSE -metric_value_numeric END, model)) AS INT) AS rank_filled FROM k""", ("v_ref",))
def e8(spark, d):
    k = V.v_ref(spark, d).withColumn("rank_given", F.when(
        (F.col("reference_source") == "board") & (F.length("model") == 18) & (F.col("metric_value_numeric") > 1.5), 3))
    k = k.withColumns({"score": T.comparison_score("metric_value_numeric", F.col("leaderboard_metric_name") == "RMSE"),
                       "given": F.col("rank_given").isNotNull()})
    n = O.row_numbers(k, ["dataset", "leaderboard_metric_name", "given"], ["score", "model"], "_i")
    return n.select("dataset", "model", F.coalesce("rank_given", (F.col("_i") + 1).cast("int")).alias("rank_filled"))


@query("e9_running_maximum", """
SELECT user_id, event_id, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS running_max FROM events""")
def e9(spark, d):
    from evalspark.operators.ordering import running_max
    e = V.table(spark, d, "events").select("user_id", "event_id", "ts", "value")
    return running_max(e, ["user_id"], ["ts", "event_id"], "value").select("user_id", "event_id", "running_max")


@query("e10_running_total_under_budget", """
WITH s AS (SELECT event_type, user_id, round(sum(value), 2) AS cost FROM events GROUP BY ALL),
c AS (SELECT *, sum(cost) OVER (PARTITION BY event_type ORDER BY cost, user_id) AS spent FROM s)
SELECT event_type, count(*) FILTER (spent <= 20000) AS fits, count(*) AS n_items FROM c GROUP BY event_type""")
def e10(spark, d):
    s = V.table(spark, d, "events").groupBy("event_type", "user_id").agg(F.round(F.sum("value"), 2).alias("cost"))
    c = O.prefix_sums(s, ["event_type"], "cost", {"n": F.lit(1), "spend": F.col("cost")})
    left = F.lit(20000.0) - F.col("spend_before")
    fits = F.when(left >= F.col("spend"), F.col("n")).otherwise(F.greatest(F.floor(left / F.col("cost")), F.lit(0)))
    return c.groupBy("event_type").agg(F.sum(fits).alias("fits"), F.sum("n").alias("n_items"))


@query("e11_band_around_best", """
SELECT run_name, dataset, model FROM (SELECT *, min(score) OVER (PARTITION BY run_name, dataset) AS b FROM v_analysis)
WHERE abs(score - b) <= greatest(0.05 * abs(b), 1e-12)""", VA)
def e11(spark, d):
    b = F.min("comparison_score").over(Window.partitionBy(*RD))
    a = V.v_analysis(spark, d).withColumn("_b", b)
    return a.where(F.abs(F.col("comparison_score") - F.col("_b")) <= F.greatest(0.05 * F.abs("_b"), F.lit(R.EPS))).select(
        *RD, "model")


@query("e12_winner_change", """
WITH b AS (SELECT run_name, dataset, arg_min(model, (score, model)) AS model FROM v_analysis GROUP BY ALL)
SELECT run_name, dataset, model, coalesce(model <> lag(model) OVER (PARTITION BY dataset ORDER BY run_name), false) AS changed FROM b""", VA)
def e12(spark, d):
    b = R.best_by_score(V.v_analysis(spark, d), RD).select(*RD, "model")
    prev = F.lag("model").over(Window.partitionBy("dataset").orderBy("run_name"))
    return b.withColumn("changed", F.coalesce(F.col("model") != prev, F.lit(False)))


@query("e13_stage_durations_and_eta", """
WITH s AS (SELECT user_id, event_id, event_type, epoch_us(ts) AS t, lead(epoch_us(ts)) OVER w AS nt, first_value(epoch_us(ts)) OVER w AS ft,
  row_number() OVER w AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
f AS (SELECT *, CASE WHEN pos = n THEN pos - 1 ELSE pos END AS finished FROM s),
m AS (SELECT *, (coalesce(nt, t) - ft) // nullif(finished, 0) AS mean_us FROM f)
SELECT user_id, event_id, event_type AS stage, CASE WHEN pos = n THEN 'running' ELSE 'completed' END AS status,
 round((nt - t)::DOUBLE / 1e6::DOUBLE, 6) AS duration_seconds, finished, n - finished AS remaining, round(mean_us / 1e6::DOUBLE, 6) AS mean_seconds,
 round(mean_us * (n - finished) / 1e6::DOUBLE, 6) AS eta_seconds FROM m""")
def e13(spark, d):
    """Every user's events as the stages of one run: a row per stage, remaining stages counted from the data."""
    e = V.table(spark, d, "events").withColumn("started", F.unix_micros(F.col("ts").cast("timestamp")))
    out = R.stage_durations(e, ["user_id"], ["started", "event_id"], "started", "event_type")
    return rounded(out, "duration_seconds", "mean_seconds", "eta_seconds")


@query("b27_token_estimate", """
WITH s AS (SELECT dataset, count(*) AS n_rows FROM v_entity GROUP BY dataset),
t AS (SELECT *, greatest(round_even(n_rows * 0.8::DOUBLE, 0), 1)::BIGINT AS estimated_train_rows FROM s),
c AS (SELECT *, greatest(round_even(0.1::DOUBLE * estimated_train_rows, 0)::BIGINT, 32) AS estimated_columns, 11::BIGINT AS estimated_fits FROM t)
SELECT *, estimated_train_rows * estimated_columns * estimated_fits AS estimated_tokens,
 estimated_train_rows * estimated_columns * estimated_fits <= 100000 AS fits_daily_budget FROM c""", ("v_entity",))
def b27(spark, d):
    sizes = V.v_entity(spark, d).groupBy("dataset").agg(F.count(F.lit(1)).alias("n_rows"))
    return R.token_estimate(sizes, "n_rows", 100_000)


# --- F: sorts and top-k ---------------------------------------------------------------------------------------------

@query("f1_mixed_sort_nulls_last", """
SELECT run_name, dataset, model, attempt, row_number() OVER (PARTITION BY run_name, dataset ORDER BY test_roc_auc DESC NULLS LAST, test_rmse ASC NULLS LAST, model, attempt) AS place
FROM v_metrics""", VM)
def f1(spark, d):
    w = Window.partitionBy(*RD).orderBy(F.desc_nulls_last("test_roc_auc"), F.asc_nulls_last("test_rmse"), "model", "attempt")
    return V.v_metrics(spark, d).select(*RD, "model", "attempt", F.row_number().over(w).alias("place"))


@query("f2_top_k_per_leaderboard", """
WITH k AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY CASE WHEN leaderboard_metric_name = 'RMSE' THEN metric_value_numeric ELSE -metric_value_numeric END, model) AS rn FROM v_ref)
SELECT dataset, CAST(rn AS INT) AS rank_in_group, model, metric_value_numeric FROM k WHERE rn <= 10""", ("v_ref",))
def f2(spark, d):
    score = T.comparison_score("metric_value_numeric", F.col("leaderboard_metric_name") == "RMSE")
    return O.top_rows(V.v_ref(spark, d), ["dataset"], [score, F.col("model")], 10).select(
        "dataset", "rank_in_group", "model", "metric_value_numeric")


@query("f3_nth_best_value", """
WITH k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rn FROM events)
SELECT event_type, event_id, value FROM k WHERE rn = 10""")
def f3(spark, d):
    e = V.table(spark, d, "events").select("event_type", "event_id", (-F.col("value")).alias("neg"))
    cut = O.nth_smallest(e, ["event_type"], ["neg", "event_id"], F.least(F.lit(10), F.col("n_rows")))
    return cut.select("event_type", F.col("cut.event_id").alias("event_id"), (-F.col("cut.neg")).alias("value"))


@query("f4_cap_selected_features", """
WITH s AS (SELECT label AS dataset, pos AS feature, avg(x) AS magnitude, count(*) AS n FROM v_long GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY abs(magnitude) DESC, feature) AS rn FROM s)
SELECT dataset, feature, rn AS selection_rank, round(magnitude, 6) AS magnitude FROM k WHERE rn <= greatest(1, ceil(n * 0.1)) AND (abs(magnitude) > 1e-10 OR rn = 1)""", ("v_long",))
def f4(spark, d):
    from evalspark.operators.features import cap_selection
    s = V.v_long(spark, d).groupBy(F.col("label").alias("dataset"), F.col("pos").alias("feature")).agg(
        F.avg("x").alias("magnitude"), F.count(F.lit(1)).alias("n"))
    return cap_selection(s, ["dataset"], "n").select("dataset", "feature", "selection_rank", r("magnitude").alias("magnitude"))


SEED_HASH = "CAST('0x' || substr(sha1(concat('{seed}:', CAST({k} AS VARCHAR))), 1, 12) AS BIGINT)"


@query("f5_seeded_group_sample", f"""
WITH k AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY {SEED_HASH.format(seed=7, k='event_id')}, event_id) AS rn FROM events)
SELECT event_type, event_id FROM k WHERE rn <= 200""")
def f5(spark, d):
    from evalspark.operators.splits import seeded_sample
    return seeded_sample(V.table(spark, d, "events").select("event_type", "event_id"), ["event_type"], "event_id", 200, 7)


@query("f6_best_per_workflow", """
SELECT run_name, dataset, workflow, arg_min(model, (score, model)) AS model, round(min(score), 6) AS score FROM v_analysis GROUP BY ALL""", VA)
def f6(spark, d):
    b = R.best_by_score(V.v_analysis(spark, d), [*RD, "workflow"])
    return b.select(*RD, "workflow", "model", r("comparison_score").alias("score"))


# --- G: set operations and signatures ---------------------------------------------------------------------------------

@query("g1_union_unequal_schemas", """
SELECT event_type AS dataset, count(*) AS n_rows, round(avg(value), 6) AS mean_value, NULL::VARCHAR AS first_source FROM events GROUP BY 1
UNION ALL SELECT lang, count(*), NULL, min(source) FROM documents GROUP BY 1""")
def g1(spark, d):
    a = V.table(spark, d, "events").groupBy(F.col("event_type").alias("dataset")).agg(
        F.count(F.lit(1)).alias("n_rows"), r(F.avg("value")).alias("mean_value"))
    b = V.table(spark, d, "documents").groupBy(F.col("lang").alias("dataset")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("source").alias("first_source"))
    return a.unionByName(b, allowMissingColumns=True)


@query("g2_combine_reference_frames", """
WITH u AS (SELECT 0 AS o, trim(dataset) AS dataset, trim(model) AS model, metric_value, true AS is_top10_entry, reference_source FROM v_ref
 UNION ALL SELECT 1, dataset, model, metric_value, NULL, 'second' FROM v_ref WHERE reference_source = 'board'
 UNION ALL SELECT 2, dataset, concat(model, '-x'), metric_value, NULL, 'third' FROM v_ref WHERE metric_value_numeric > 2)
SELECT dataset, model, metric_value, arg_min(reference_source, o) AS reference_source, coalesce(arg_min(is_top10_entry, o), true) AS is_top10_entry
FROM u GROUP BY dataset, model, metric_value""", ("v_ref",))
def g2(spark, d):
    from evalspark.operators.reports import combine_references
    ref = V.v_ref(spark, d).select("dataset", "model", "metric_value", "reference_source", "metric_value_numeric")
    a = ref.drop("metric_value_numeric").withColumn("is_top10_entry", F.lit(True))
    b = ref.where("reference_source = 'board'").drop("metric_value_numeric").withColumn("reference_source", F.lit("second"))
    c = (ref.where("metric_value_numeric > 2").drop("metric_value_numeric")
         .withColumns({"model": F.concat("model", F.lit("-x")), "reference_source": F.lit("third")}))
    out = combine_references([a, b, c], ["dataset", "model", "metric_value"])
    return out.select("dataset", "model", "metric_value", "reference_source", "is_top10_entry")


@query("g3_names_in_both", """
SELECT model FROM v_pred WHERE split = 'train' INTERSECT SELECT model FROM v_pred WHERE split = 'test' AND observed > 1""", VP)
def g3(spark, d):
    p = V.v_pred(spark, d)
    # One aggregate, in the tasks first: an intersection would move every row, all rows of a name into one task.
    seen = p.groupBy("model").agg(F.max(F.col("split") == "train").alias("a"), F.max((F.col("split") == "test") & (F.col("observed") > 1)).alias("b"))
    return seen.where("a AND b").select("model")


@query("g4_key_set_difference", """
SELECT doc_id FROM documents WHERE n_chars < 2000 EXCEPT SELECT doc_id FROM labels""")
def g4(spark, d):
    docs = V.table(spark, d, "documents").where("n_chars < 2000").select("doc_id").distinct()
    return docs.join(V.table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("g5_complete_cases", """
SELECT run_name, dataset, count(DISTINCT model) AS models FROM v_analysis GROUP BY ALL
HAVING count(DISTINCT model) = (SELECT count(DISTINCT model) FROM v_analysis)""", VA)
def g5(spark, d):
    return R.complete_cases(V.v_analysis(spark, d), RD, "model")


@query("g6_content_signatures", """
WITH r AS (SELECT source, doc_id, md5(text) AS k, n_chars, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 100000 AS blk FROM documents),
b AS (SELECT source, blk, count(*) AS n, sha256(string_agg(k, e'\\n' ORDER BY doc_id)) AS kh,
 sha256(string_agg(concat(k, '|', printf('%.12g', CAST(n_chars AS DOUBLE))), e'\\n' ORDER BY doc_id)) AS rh FROM r GROUP BY ALL)
SELECT source AS dataset, CAST(sum(n) AS BIGINT) AS n_rows, sha256(string_agg(kh, e'\\n' ORDER BY blk)) AS key_hash,
 sha256(string_agg(rh, e'\\n' ORDER BY blk)) AS row_hash FROM b GROUP BY source""")
def g6(spark, d):
    """Ordered signature in blocks of 100,000 rows (see ``order_free_signature`` for one without order)."""
    e = V.table(spark, d, "documents").select(F.col("source").alias("dataset"), "doc_id", F.md5("text").alias("key"), "n_chars")
    row = F.concat_ws("|", "key", C.stable_float_text("n_chars"))
    return S.ordered_signature(e.withColumn("row", row), ["dataset"], "doc_id", {"key_hash": "key", "row_hash": "row"})


@query("g6_order_free_signatures", """
SELECT event_type AS dataset, count(*) AS n_rows, CAST(bit_xor(h) AS BIGINT) AS sig_xor, CAST(sum(h) AS BIGINT) AS sig_sum
FROM (SELECT event_type, CAST('0x' || substr(sha1(concat(CAST(event_id AS VARCHAR), '|', printf('%.12g', value))), 1, 12) AS BIGINT) AS h FROM events) GROUP BY 1""")
def g6b(spark, d):
    e = V.table(spark, d, "events").select(F.col("event_type").alias("dataset"), "event_id", "value")
    return S.order_free_signature(e, ["dataset"], [F.col("event_id").cast("string"), C.stable_float_text("value")])


@query("g7_stacked_train_test_union", """
SELECT dataset, model, split, row_id, observed, round(predicted, 6) AS predicted FROM v_pred WHERE split = 'train'
UNION ALL SELECT dataset, model, split, row_id, observed, round(predicted, 6) FROM v_pred WHERE split = 'test'""", VP)
def g7(spark, d):
    p = V.v_pred(spark, d).select("dataset", "model", "split", "row_id", "observed", r("predicted").alias("predicted"))
    return p.where("split = 'train'").unionByName(p.where("split = 'test'"))
