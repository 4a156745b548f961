"""Evaluation-shaped views over the provided tables: the same rows as DataFrames and as SQL text.

The tables hold orders, events and documents; the views read them as predictions, metric rows, reference
leaderboards, keyed datasets, run comparisons and feature vectors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def half_away(c: Column, digits: int) -> Column:
    """A value of zero or more rounded as the SQL engine does it: scaled, to the nearest whole, scaled back.

    ``F.round`` rounds the shortest decimal text instead, which differs next to a half.
    """
    return F.round(c * F.lit(10.0 ** digits), 0) / F.lit(10.0 ** digits)


def plain_text(c: Column, digits: int) -> Column:
    """Text of a rounded value without an exponent, which Spark writes below 0.001."""
    small = F.regexp_replace(c.cast(f"decimal(30,{digits})").cast("string"), "0+$", "")
    return F.when((c > 0) & (c < 0.001), small).otherwise(c.cast("string"))


# part.p_brand read as a (model, workflow) pair.
MODELS = [
    ("Brand#1", "Random Forest", "Conventional ML"),
    ("Brand#2", "SVR", "Conventional ML"),
    ("Brand#3", "ElasticNetCV", "Conventional ML"),
    ("Brand#4", "XGBoost", "Conventional ML"),
    ("Brand#5", "CatBoost", "Conventional ML"),
    ("Brand#6", "Tuned Random Forest", "Tuned conventional ML"),
    ("Brand#7", "Random Forest GA", "ga_tuned"),
    ("Brand#8", "SVR GA", "ga_tuned"),
    ("Brand#9", "XGBoost GA", "ga_tuned"),
    ("Brand#10", "TabPFN", "Conventional ML"),
    ("Brand#11", "Chemprop v2 D-MPNN", "Chemprop v2"),
    ("Brand#12", "Chemprop v2 CMPNN", "Chemprop v2"),
    ("Brand#13", "ChemML MLP", "ChemML deep learning"),
    ("Brand#14", "Uni-Mol V1", "Uni-Mol"),
    ("Brand#15", "MapLight + GNN", "MapLight + GNN"),
    ("Brand#16", "MapLight CatBoost", "Conventional ML"),
    ("Brand#17", "CFA (conventional)", "CFA"),
    ("Brand#18", "Ensemble (OOF stacking: RidgeCV)", "Ensemble"),
    ("Brand#19", "Ensemble (Weighted average: inverse train RMSE)", "Ensemble"),
    ("Brand#20", "Ensemble (Simple average)", "Ensemble"),
    ("Brand#21", "AdaBoost", "Conventional ML"),
    ("Brand#22", "Extra Trees", "Conventional ML"),
    ("Brand#23", "Chemprop v2 AttentiveFP", "Chemprop v2"),
    ("Brand#24", "TabularCNN", "ChemML deep learning"),
    ("Brand#25", "KNN", "Conventional ML"),
]
MODEL_VALUES = ", ".join("('{}', '{}', '{}')".format(*m) for m in MODELS)

VIEW_SQL = {
    # Long predictions: five datasets by three models; m_gap lacks the rows of one k value (alignment cases).
    "v_pred": """
SELECT event_type AS dataset, m.model AS model, event_id AS row_id, user_id AS entity_key,
       CASE WHEN CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) < 25 THEN 'test' ELSE 'train' END AS split,
       value AS observed,
       CASE m.model WHEN 'm_k' THEN CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE)
                    WHEN 'm_lin' THEN value * 0.9 + 5 ELSE CAST(user_id AS DOUBLE) END AS predicted
FROM events CROSS JOIN (SELECT 'm_k' AS model UNION ALL SELECT 'm_lin' UNION ALL SELECT 'm_gap') m
WHERE NOT (m.model = 'm_gap' AND regexp_extract(props, '([0-9]+)', 1) = '7')""",
    # 0/1 target with one score inside [0, 1] and one that needs the sigmoid rule.
    "v_binary": """
SELECT d.lang AS dataset, m.model AS model, d.doc_id AS row_id, CAST(l.quality AS DOUBLE) AS observed,
       CAST(CASE m.model WHEN 'unit' THEN 1.0 / (1.0 + CAST(d.n_chars AS DOUBLE) / 1000.0)
                         ELSE (CAST(d.n_chars AS DOUBLE) - 1000) / 500.0 END AS DOUBLE) AS predicted
FROM documents d JOIN labels l ON d.doc_id = l.doc_id
CROSS JOIN (SELECT 'unit' AS model UNION ALL SELECT 'raw') m""",
    # Metric rows: dataset x model x attempt x run, with errors, statuses and three metric kinds.
    "v_metrics": f"""
SELECT concat('run_', o_orderstatus) AS run_name, n_name AS dataset, b.model AS model, b.workflow AS workflow,
       p_type AS attempt,
       CASE n_nationkey % 3 WHEN 0 THEN 'RMSE' WHEN 1 THEN 'ROC-AUC' ELSE 'Spearman' END AS primary_metric,
       CASE n_nationkey % 3
            WHEN 0 THEN round(avg(l_extendedprice * (1 - l_discount)) / 9973, 6)
            ELSE round(10 * sum(l_discount * l_extendedprice) / sum(l_extendedprice), 6) END AS primary_metric_value,
       CASE WHEN n_nationkey % 3 <> 1 THEN round(avg(l_extendedprice) / 9973, 6) END AS test_rmse,
       CASE WHEN n_nationkey % 3 = 1 THEN round(10 * sum(l_discount * l_extendedprice) / sum(l_extendedprice), 6) END
            AS test_roc_auc,
       sum(l_quantity) AS elapsed_seconds, count(*) AS n_train, max(l_orderkey) AS last_order,
       CASE WHEN b.model = 'SVR' AND p_type = 'ECONOMY' THEN 'timeout' WHEN b.model = 'XGBoost' THEN 'nan' END AS error,
       CASE WHEN p_type = 'PROMO' AND b.model = 'KNN' THEN 'skipped_small' ELSE 'completed' END AS status
FROM lineitem JOIN part ON p_partkey = l_partkey
JOIN (VALUES {MODEL_VALUES}) b(brand, model, workflow) ON b.brand = p_brand
JOIN orders ON o_orderkey = l_orderkey
JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
GROUP BY o_orderstatus, n_name, n_nationkey, b.model, b.workflow, p_type""",
    # One successful row per run, dataset and model: best attempt, distance to the best of the dataset.
    "v_analysis": """
SELECT *, CASE WHEN task_kind = 'classification' THEN max(value) OVER w - value ELSE value - min(value) OVER w END AS delta
FROM (SELECT run_name, dataset, model, workflow, primary_metric,
        CASE WHEN max(test_roc_auc) IS NOT NULL THEN 'classification' ELSE 'regression' END AS task_kind,
        CASE WHEN max(test_roc_auc) IS NOT NULL THEN max(test_roc_auc) ELSE min(test_rmse) END AS value,
        CASE WHEN max(test_roc_auc) IS NOT NULL THEN -max(test_roc_auc) ELSE min(test_rmse) END AS score,
        min(test_rmse) AS test_rmse, max(test_roc_auc) AS test_roc_auc, sum(elapsed_seconds) AS elapsed_seconds,
        CAST(sum(n_train) AS BIGINT) AS n_train
      FROM v_metrics WHERE error IS NULL OR error = 'nan' GROUP BY run_name, dataset, model, workflow, primary_metric)
WINDOW w AS (PARTITION BY run_name, dataset)""",
    # Reference leaderboard rows with a text value to parse.
    "v_ref": """
SELECT n_name AS dataset, s_name AS model, round(abs(s_acctbal) / 4000, 4) AS metric_value_numeric,
       concat(CAST(round(abs(s_acctbal) / 4000, 4) AS VARCHAR(24)), ' +/- 0.1') AS metric_value,
       CASE n_nationkey % 3 WHEN 0 THEN 'RMSE' WHEN 1 THEN 'AUROC' ELSE 'Spearman' END AS leaderboard_metric_name,
       CASE WHEN s_acctbal < 0 THEN 'archive' ELSE 'board' END AS reference_source
FROM supplier JOIN nation ON n_nationkey = s_nationkey""",
    # Keyed dataset with a group key and a target.
    "v_entity": """
SELECT lang AS dataset, doc_id AS row_id, text AS entity_key, source AS group_key, CAST(n_chars AS DOUBLE) AS target
FROM documents""",
    # Two-sided run comparison input.
    "v_runs": """
SELECT concat('run_', o_orderstatus) AS run_name, o_orderpriority AS dataset, count(*) AS n_rows,
       count(DISTINCT o_custkey) AS n_keys, min(o_orderkey) AS first_key, round(sum(o_totalprice), 2) AS total
FROM orders GROUP BY o_orderstatus, o_orderpriority""",
    # Feature vectors in long form.
    "v_long": """
SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS pos, CAST(unnest(embedding) AS DOUBLE) AS x
FROM embeddings""",
}


def _k() -> Column:
    return F.regexp_extract("props", "([0-9]+)", 1)


def v_pred(spark: SparkSession, d: str) -> DataFrame:
    # The pattern runs once an event, below the models, not for each use in each model's row.
    ev = table(spark, d, "events").select("event_type", "event_id", "user_id", "value", _k().alias("k"))
    models = F.explode(F.array(F.lit("m_k"), F.lit("m_lin"), F.lit("m_gap")))
    value = F.col("value")
    predicted = (F.when(F.col("model") == "m_k", F.col("k").cast("double"))
                 .when(F.col("model") == "m_lin", value * 0.9 + 5).otherwise(F.col("user_id").cast("double")))
    return (ev.withColumn("model", models).where(~((F.col("model") == "m_gap") & (F.col("k") == "7")))
            .select(F.col("event_type").alias("dataset"), "model", F.col("event_id").alias("row_id"),
                    F.col("user_id").alias("entity_key"),
                    F.when(F.col("k").cast("int") < 25, "test").otherwise("train").alias("split"),
                    value.alias("observed"), predicted.alias("predicted")))


def v_binary(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", F.col("n_chars").cast("double").alias("n"))
    labels = table(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("observed"))
    both = docs.join(labels, "doc_id").withColumn("model", F.explode(F.array(F.lit("unit"), F.lit("raw"))))
    n = F.col("n")
    return both.select(F.col("lang").alias("dataset"), "model", F.col("doc_id").alias("row_id"), "observed",
                       F.when(F.col("model") == "unit", 1.0 / (1.0 + n / 1000.0))
                       .otherwise((n - 1000) / 500.0).alias("predicted"))


def v_metrics(spark: SparkSession, d: str) -> DataFrame:
    names = F.create_map(*[F.lit(x) for b, m, _ in MODELS for x in (b, m)])
    flows = F.create_map(*[F.lit(x) for b, _, w in MODELS for x in (b, w)])
    li = table(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_extendedprice", "l_discount", "l_quantity")
    part = table(spark, d, "part").select("p_partkey", "p_brand", "p_type")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    cust = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, d, "nation").select("n_nationkey", "n_name")
    g = (li.join(part, F.col("p_partkey") == F.col("l_partkey"))
         .join(orders, F.col("o_orderkey") == F.col("l_orderkey"))
         .join(cust, F.col("c_custkey") == F.col("o_custkey"))
         .join(nation, F.col("n_nationkey") == F.col("c_nationkey"))
         .groupBy("o_orderstatus", "n_name", "n_nationkey", "p_brand", "p_type")
         .agg(F.avg(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("_net"),
              F.avg("l_extendedprice").alias("_gross"),
              (10 * F.sum(F.col("l_discount") * F.col("l_extendedprice")) / F.sum("l_extendedprice")).alias("_rate"),
              F.sum("l_quantity").alias("elapsed_seconds"), F.count(F.lit(1)).alias("n_train"), F.max("l_orderkey").alias("last_order"))
         .where(F.element_at(names, F.col("p_brand")).isNotNull()))
    kind = F.col("n_nationkey") % 3
    model = F.element_at(names, F.col("p_brand"))
    return g.withColumns({"model": model, "workflow": F.element_at(flows, F.col("p_brand"))}).select(
        F.concat(F.lit("run_"), "o_orderstatus").alias("run_name"), F.col("n_name").alias("dataset"), "model",
        "workflow", F.col("p_type").alias("attempt"),
        F.when(kind == 0, "RMSE").when(kind == 1, "ROC-AUC").otherwise("Spearman").alias("primary_metric"),
        F.when(kind == 0, F.round(F.col("_net") / 9973, 6)).otherwise(F.round("_rate", 6))
        .alias("primary_metric_value"),
        F.when(kind != 1, F.round(F.col("_gross") / 9973, 6)).alias("test_rmse"),
        F.when(kind == 1, F.round("_rate", 6)).alias("test_roc_auc"),
        "elapsed_seconds", "n_train", "last_order",
        F.when((F.col("model") == "SVR") & (F.col("p_type") == "ECONOMY"), "timeout")
        .when(F.col("model") == "XGBoost", "nan").alias("error"),
        F.when((F.col("p_type") == "PROMO") & (F.col("model") == "KNN"), "skipped_small").otherwise("completed")
        .alias("status"))


def v_analysis(spark: SparkSession, d: str) -> DataFrame:
    from evalspark.functions.cleaning import has_error
    from evalspark.operators import reports as R

    g = (v_metrics(spark, d).where(~has_error("error"))
         .groupBy("run_name", "dataset", "model", "workflow", "primary_metric")
         .agg(F.min("test_rmse").alias("test_rmse"), F.max("test_roc_auc").alias("test_roc_auc"),
              F.sum("elapsed_seconds").alias("elapsed_seconds"), F.sum("n_train").alias("n_train"))
         .withColumn("error", F.lit(None).cast("string")))
    a = R.with_comparison(R.with_analysis_metric(g))
    return R.with_delta_from_best(a, ["run_name", "dataset"])


def v_ref(spark: SparkSession, d: str) -> DataFrame:
    sup = table(spark, d, "supplier")
    nation = table(spark, d, "nation").select("n_nationkey", "n_name")
    kind = F.col("n_nationkey") % 3
    v = half_away(F.abs("s_acctbal") / 4000, 4)
    return (sup.join(nation, F.col("n_nationkey") == F.col("s_nationkey"))
            .select(F.col("n_name").alias("dataset"), F.col("s_name").alias("model"), v.alias("metric_value_numeric"),
                    F.concat(plain_text(v, 4), F.lit(" +/- 0.1")).alias("metric_value"),
                    F.when(kind == 0, "RMSE").when(kind == 1, "AUROC").otherwise("Spearman")
                    .alias("leaderboard_metric_name"),
                    F.when(F.col("s_acctbal") < 0, "archive").otherwise("board").alias("reference_source")))


def v_entity(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(
        F.col("lang").alias("dataset"), F.col("doc_id").alias("row_id"), F.col("text").alias("entity_key"),
        F.col("source").alias("group_key"), F.col("n_chars").cast("double").alias("target"))


def v_runs(spark: SparkSession, d: str) -> DataFrame:
    """Distinct customers are counted from a (run, dataset, customer) pre-aggregate, not by an expanded plan."""
    o = table(spark, d, "orders").select("o_orderstatus", "o_orderpriority", "o_custkey", "o_orderkey", "o_totalprice")
    per = o.groupBy("o_orderstatus", "o_orderpriority", "o_custkey").agg(
        F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("k"), F.sum("o_totalprice").alias("t"))
    return per.groupBy("o_orderstatus", "o_orderpriority").agg(
        F.sum("n").alias("n_rows"), F.count("o_custkey").alias("n_keys"), F.min("k").alias("first_key"),
        F.round(F.sum("t"), 2).alias("total")).select(
        F.concat(F.lit("run_"), "o_orderstatus").alias("run_name"), F.col("o_orderpriority").alias("dataset"),
        "n_rows", "n_keys", "first_key", "total")


def v_long(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("pos", "x")) \
        .withColumn("x", F.col("x").cast("double"))
