"""Splits and folds, feature statistics, applicability domain."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.functions import families
from evalspark.operators import domain as D
from evalspark.operators import features as X
from evalspark.operators import joins as J
from evalspark.operators import neighbours as N
from evalspark.operators import signatures as G
from evalspark.operators import splits as S
from evalspark.plans import views as V
from evalspark.plans.join_queries import SEED_HASH
from evalspark.plans.registry import query, r, rounded

H42 = SEED_HASH.format(seed=42, k="event_id")


def events(spark, d):
    return V.table(spark, d, "events").select(F.col("event_type").alias("dataset"), "event_id", "user_id",
                                              F.col("value").alias("target"))


@query("i1_random_holdout", f"""
WITH k AS (SELECT event_type AS dataset, event_id, row_number() OVER (PARTITION BY event_type ORDER BY {H42}, event_id) AS rn,
 count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT dataset, event_id, CASE WHEN rn <= ceil(n * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM k""")
def i1(spark, d):
    return S.random_holdout(events(spark, d).select("dataset", "event_id"), ["dataset"], "event_id", 0.2)


BINS = """e AS (SELECT event_type AS dataset, event_id, value AS y, quantile_cont(value, 0.25) OVER w AS q1, quantile_cont(value, 0.5) OVER w AS q2,
 quantile_cont(value, 0.75) OVER w AS q3 FROM events WINDOW w AS (PARTITION BY event_type)),
b AS (SELECT dataset, event_id, CASE WHEN y <= q1 THEN 0 WHEN y <= q2 THEN 1 WHEN y <= q3 THEN 2 ELSE 3 END AS bin FROM e)"""


@query("i2_stratified_holdout", f"""WITH {BINS},
k AS (SELECT *, row_number() OVER (PARTITION BY dataset, bin ORDER BY {H42}, event_id) AS rn, count(*) OVER (PARTITION BY dataset, bin) AS n FROM b)
SELECT dataset, event_id, bin, CASE WHEN rn <= ceil(n * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS split, 'target_quartiles' AS split_strategy FROM k""")
def i2(spark, d):
    return S.stratified_holdout(events(spark, d).drop("user_id"), ["dataset"], "event_id", "target", 0.2).drop("target")


GROUPS = """g AS (SELECT event_type AS dataset, user_id, count(*) AS size FROM events GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY size DESC, user_id) AS i, sum(size) OVER (PARTITION BY dataset) AS n FROM g)"""


@query("i3_group_holdout", f"""
WITH RECURSIVE {GROUPS},
w AS (SELECT dataset, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS c, CAST(least(greatest(round_even(max(n) * 0.2::DOUBLE, 0), 1), max(n) - 1) AS BIGINT) AS goal, false AS took
  FROM o GROUP BY dataset
 UNION ALL SELECT w.dataset, o.i, CASE WHEN c < goal AND (abs(c + size - goal) <= abs(c - goal) OR c = 0) THEN c + size ELSE c END, goal,
  c < goal AND (abs(c + size - goal) <= abs(c - goal) OR c = 0) FROM w JOIN o ON o.dataset = w.dataset AND o.i = w.i + 1)
SELECT e.event_type AS dataset, e.event_id, CASE WHEN w.took THEN 'test' ELSE 'train' END AS split
FROM events e JOIN o ON o.dataset = e.event_type AND o.user_id = e.user_id JOIN w ON w.dataset = o.dataset AND w.i = o.i""")
def i3(spark, d):
    return S.group_holdout(events(spark, d), ["dataset"], "user_id", 0.2).select("dataset", "event_id", "split")


@query("i4_predefined_split", """
WITH k AS (SELECT o_orderstatus AS dataset, o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN ' Train' WHEN '2-HIGH' THEN 'training'
 WHEN '3-MEDIUM' THEN CASE WHEN o_orderstatus = 'P' THEN 'train' ELSE 'HoldOut' END ELSE 'unused' END AS lab FROM orders)
SELECT dataset, o_orderkey, CASE WHEN lower(trim(lab)) = 'holdout' THEN 'test' ELSE 'train' END AS split, dataset <> 'P' AS usable FROM k WHERE lab <> 'unused'""")
def i4(spark, d):
    p = F.col("o_orderpriority")
    lab = (F.when(p == "1-URGENT", " Train").when(p == "2-HIGH", "training")
           .when(p == "3-MEDIUM", F.when(F.col("o_orderstatus") == "P", "train").otherwise("HoldOut")).otherwise("unused"))
    o = V.table(spark, d, "orders").select(F.col("o_orderstatus").alias("dataset"), "o_orderkey", lab.alias("lab"))
    return S.predefined_split(o, ["dataset"], "lab").drop("lab")


@query("i5_hash_split", """
WITH k AS (SELECT lang AS dataset, doc_id, row_number() OVER (PARTITION BY lang ORDER BY CAST('0x' || substr(sha1(text), 1, 12) AS BIGINT) DESC, doc_id) AS rn,
 count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT dataset, doc_id, CASE WHEN rn <= least(greatest(round_even(n * 0.25::DOUBLE, 0), 1), n - 1) THEN 'test' ELSE 'train' END AS split FROM k""")
def i5(spark, d):
    docs = V.table(spark, d, "documents").select(F.col("lang").alias("dataset"), "doc_id", "text")
    return S.hash_split(docs, ["dataset"], "text", "doc_id", 0.25).drop("text")


@query("i6_random_kfold", f"""
SELECT event_type AS dataset, event_id, CAST(5 AS BIGINT) AS folds, (row_number() OVER (PARTITION BY event_type ORDER BY {H42}, event_id) - 1) % 5 AS fold FROM events""")
def i6(spark, d):
    k = S.random_kfold(events(spark, d).select("dataset", "event_id"), ["dataset"], "event_id", 5)
    return k.withColumn("folds", F.col("folds").cast("long"))


@query("i7_stratified_kfold", f"""WITH {BINS}
SELECT dataset, event_id, bin, (row_number() OVER (PARTITION BY dataset, bin ORDER BY {H42}, event_id) - 1) % 5 AS fold, 'target_quartiles' AS cv_strategy FROM b""")
def i7(spark, d):
    k = S.stratified_kfold(events(spark, d).drop("user_id"), ["dataset"], "event_id", "target", 5)
    return k.select("dataset", "event_id", "bin", "fold", "cv_strategy")


@query("i8_group_kfold", f"""
WITH RECURSIVE {GROUPS},
w AS (SELECT DISTINCT dataset, CAST(0 AS BIGINT) AS i, [0, 0, 0, 0, 0]::BIGINT[] AS loads, CAST(0 AS BIGINT) AS fold FROM o
 UNION ALL SELECT w.dataset, o.i, list_transform(loads, lambda x, j: CASE WHEN j = list_position(loads, list_min(loads)) THEN x + size ELSE x END),
  CAST(list_position(loads, list_min(loads)) AS BIGINT) - 1 FROM w JOIN o ON o.dataset = w.dataset AND o.i = w.i + 1)
SELECT e.event_type AS dataset, e.event_id, w.fold FROM events e JOIN o ON o.dataset = e.event_type AND o.user_id = e.user_id
JOIN w ON w.dataset = o.dataset AND w.i = o.i""")
def i8(spark, d):
    return S.group_kfold(events(spark, d), ["dataset"], "user_id", 5).select("dataset", "event_id", "fold")


@query("i9_inner_folds_with_fallback", f"""
SELECT event_type AS dataset, event_id, (row_number() OVER (PARTITION BY event_type ORDER BY {H42}, event_id) - 1) % 3 AS fold, 'random' AS cv_strategy FROM events""")
def i9(spark, d):
    """Every dataset has one group here, so group folds fall back to random folds."""
    one = events(spark, d).withColumn("grp", F.lit("same"))
    f = S.inner_folds(one, ["dataset"], "scaffold", "event_id", group="grp", folds=3)
    return f.select("dataset", "event_id", "fold", "cv_strategy")


@query("i10_split_signature_match", """
WITH k AS (SELECT event_type AS dataset, CASE WHEN user_id < 100 THEN 'train' ELSE 'test' END AS split,
  CASE WHEN user_id < 100 OR (event_type = 'view' AND user_id = 120) THEN 'train' ELSE 'test' END AS split2, CAST(event_id AS VARCHAR) AS id, user_id FROM events),
h AS (SELECT *, CAST('0x' || substr(sha1(id), 1, 12) AS BIGINT) AS h FROM k),
a AS (SELECT dataset, split, count(*) AS n, bit_xor(h) AS x FROM h GROUP BY ALL), b AS (SELECT dataset, split2 AS split, count(*) AS n, bit_xor(h) AS x FROM h GROUP BY ALL)
SELECT a.dataset, a.split, a.n = b.n AS n_rows_match, a.x = b.x AS sig_xor_match, a.n = b.n AND a.x = b.x AS all_match FROM a JOIN b ON a.dataset = b.dataset AND a.split = b.split""")
def i10(spark, d):
    e = events(spark, d)
    train = F.col("user_id") < 100
    moved = train | ((F.col("dataset") == "view") & (F.col("user_id") == 120))
    sig = lambda c: G.order_free_signature(e.withColumn("split", F.when(c, "train").otherwise("test")), ["dataset", "split"],
                                           [F.col("event_id").cast("string")])
    diff = J.full_outer_diff(sig(train), sig(moved), ["dataset", "split"], ["n_rows", "sig_xor"])
    return diff.select("dataset", "split", "n_rows_match", "sig_xor_match", "all_match")


@query("i11_derived_subsets", """
WITH k AS (SELECT 'doc' AS sheet, md5(text) AS key, n_chars, unnest(list_filter([CASE WHEN lang = 'en' THEN 'en' END, CASE WHEN n_chars > 500 THEN 'long' END], lambda x: x IS NOT NULL)) AS subset_a,
 source FROM documents),
u AS (SELECT sheet, key, n_chars, subset_a, unnest(list_filter([CASE WHEN source < 'src2' THEN 'early' END, CASE WHEN source >= 'src15' THEN 'late' END], lambda x: x IS NOT NULL)) AS subset_b FROM k),
m AS (SELECT sheet, subset_a, subset_b, key, avg(n_chars) AS target FROM u GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY subset_a, subset_b ORDER BY CAST('0x' || substr(sha1(key), 1, 12) AS BIGINT) DESC, key) AS rn, count(*) OVER (PARTITION BY subset_a, subset_b) AS n FROM m)
SELECT subset_a, subset_b, key, round(target, 6) AS target, CASE WHEN rn <= least(greatest(round_even(n * 0.2::DOUBLE, 0), 1), n - 1) THEN 'test' ELSE 'train' END AS split FROM n""")
def i11(spark, d):
    flag = lambda c: c.cast("int")
    docs = V.table(spark, d, "documents").select(
        F.lit("doc").alias("sheet"), F.md5("text").alias("key"), F.col("n_chars").cast("double").alias("target"),
        flag(F.col("lang") == "en").alias("species_en"), flag(F.col("n_chars") > 500).alias("species_long"),
        flag(F.col("source") < "src2").alias("sex_early"), flag(F.col("source") >= "src15").alias("sex_late"))
    out = S.derive_subsets(docs, ["sheet"], {"en": "species_en", "long": "species_long"},
                           {"early": "sex_early", "late": "sex_late"}, "key", "target", 0.2)
    return out.select("subset_a", "subset_b", "key", r("target").alias("target"), "split")


@query("i12_pooled_subset", """
WITH u AS (SELECT DISTINCT source_sheet, key, target, fast, slow FROM (
 SELECT 'a' AS source_sheet, md5(text) AS key, CAST(n_chars AS DOUBLE) AS target, CAST(n_chars < 300 AS INT)::DOUBLE AS fast, 0::DOUBLE AS slow FROM documents WHERE lang = 'en'
 UNION ALL SELECT 'b', md5(text), CAST(n_chars AS DOUBLE), 0, CAST(n_chars > 900 AS INT)::DOUBLE FROM documents WHERE lang = 'fr'
 UNION ALL SELECT 'c', md5(text), CAST(n_chars AS DOUBLE), CAST(n_chars < 300 AS INT)::DOUBLE, CAST(n_chars > 900 AS INT)::DOUBLE FROM documents WHERE lang = 'de'
 UNION ALL SELECT 'd', md5(text), CAST(n_chars AS DOUBLE), 0, 0 FROM documents WHERE lang = 'es'))
SELECT source_sheet, count(*) AS n_rows, round(sum(target), 3) AS target_sum, round(sum(fast), 3) AS fast, round(sum(slow), 3) AS slow,
 least(greatest(round_even((SELECT count(*) FROM u) * 0.2::DOUBLE, 0), 1), (SELECT count(*) FROM u) - 1) AS pooled_test_rows FROM u GROUP BY source_sheet""")
def i12(spark, d):
    docs = V.table(spark, d, "documents").select("lang", F.md5("text").alias("key"), F.col("n_chars").cast("double").alias("target"), "n_chars")
    fast, slow = (F.col("n_chars") < 300).cast("int").alias("fast"), (F.col("n_chars") > 900).cast("int").alias("slow")
    sheet = lambda lang, *flags: docs.where(F.col("lang") == lang).select("key", "target", *flags)
    sheets = {"a": sheet("en", fast), "b": sheet("fr", slow), "c": sheet("de", fast, slow), "d": sheet("es")}
    p = S.pooled_subset(sheets, ["fast", "slow"], "key", 0.2)
    g = p.groupBy("source_sheet").agg(
        F.count(F.lit(1)).alias("n_rows"), r(F.sum("target"), 3).alias("target_sum"), r(F.sum("fast"), 3).alias("fast"),
        r(F.sum("slow"), 3).alias("slow"))
    tests = p.agg(F.count_if(F.col("split") == "test").cast("double").alias("pooled_test_rows"))
    return g.crossJoin(F.broadcast(tests))  # one-row side


# --- J: features -----------------------------------------------------------------------------------------------

FEATS = """v AS (SELECT vec_id, pos, CASE WHEN pos = 3 THEN 0.5 WHEN pos = 5 THEN CASE WHEN x > 0.35 THEN 1 ELSE 0 END WHEN pos = 7 THEN CASE WHEN x > 0 THEN 1 ELSE 0 END ELSE x END::DOUBLE AS x FROM v_long
 UNION ALL SELECT vec_id, 100, x FROM v_long WHERE pos = 0 UNION ALL SELECT vec_id, 101, x FROM v_long WHERE pos = 1),
p AS (SELECT pos, count(*) AS n_rows, var_pop(x) AS variance, bool_and(abs(x) <= 1e-6 OR abs(x - 1) <= 1e-6) AS is_binary, avg(CASE WHEN abs(x - 1) <= 1e-6 THEN 1.0::DOUBLE ELSE 0 END) AS prevalence
 FROM v GROUP BY pos),
rp AS (SELECT pos, variance, prevalence, CASE WHEN variance <= 1e-8 THEN 'low_variance' WHEN is_binary AND (prevalence < 0.005 OR prevalence > 0.995) THEN 'binary_prevalence'
 WHEN pos >= 100 THEN 'exact_duplicate' END AS reason, CASE WHEN pos >= 100 THEN pos - 100 END AS duplicate_of FROM p)"""


def feature_cells(spark, d):
    """Embedding cells with a constant, a rare and a common 0/1 position, and two copied positions."""
    long = V.v_long(spark, d).select("vec_id", F.col("pos").cast("long").alias("pos"), "x")
    x = F.col("x")
    changed = long.withColumn("x", F.when(F.col("pos") == 3, 0.5).when(F.col("pos") == 5, F.when(x > 0.35, 1.0).otherwise(0.0))
                              .when(F.col("pos") == 7, F.when(x > 0, 1.0).otherwise(0.0)).otherwise(x))
    copies = long.where("pos < 2").withColumn("pos", F.col("pos") + 100)
    return changed.unionByName(copies)


@query("j1_low_variance_filter", f"""WITH {FEATS}
SELECT pos, round(variance, 8) AS variance, variance <= 1e-8 AS dropped FROM p""", ("v_long",))
def j1(spark, d):
    p = X.feature_profile(feature_cells(spark, d), ["pos"], "x", "vec_id")
    return p.select("pos", r("variance", 8).alias("variance"), (F.col("variance") <= 1e-8).alias("dropped"))


@query("j2_binary_prevalence_filter", f"""WITH {FEATS}
SELECT pos, is_binary, round(prevalence, 6) AS prevalence, is_binary AND (prevalence < 0.005 OR prevalence > 0.995) AS dropped FROM p""", ("v_long",))
def j2(spark, d):
    p = X.feature_profile(feature_cells(spark, d), ["pos"], "x", "vec_id")
    rare = (F.col("prevalence") < 0.005) | (F.col("prevalence") > 0.995)
    return p.select("pos", "is_binary", r("prevalence").alias("prevalence"), (F.col("is_binary") & rare).alias("dropped"))


@query("j3_exact_duplicate_columns", f"""WITH {FEATS}
SELECT pos, reason, duplicate_of FROM rp""", ("v_long",))
def j3(spark, d):
    return X.filter_report(feature_cells(spark, d), "pos", "x", "vec_id").select("pos", "reason", "duplicate_of")


@query("j4_drop_report", f"""WITH {FEATS}
SELECT reason, count(*) AS n_features, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS examples FROM rp WHERE reason IS NOT NULL GROUP BY reason""", ("v_long",))
def j4(spark, d):
    return X.drop_summary(X.filter_report(feature_cells(spark, d), "pos", "x", "vec_id"))


@query("j7_append_auxiliary_features", """
SELECT e.vec_id, len(embedding) + 2 AS width, round(list_sum(embedding::DOUBLE[]) + label + len(embedding), 4) AS total FROM embeddings e""")
def j7(spark, d):
    e = V.table(spark, d, "embeddings").withColumns({"aux__label": F.col("label").cast("double"), "aux__width": F.size("embedding").cast("double")})
    full = F.concat(F.col("embedding").cast("array<double>"), F.array("aux__label", "aux__width"))
    out = e.select("vec_id", full.alias("f"))
    return out.select("vec_id", F.size("f").cast("long").alias("width"),
                      r(F.aggregate("f", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("j8_ragged_vectors", """
WITH v AS (SELECT vec_id, label, unnest(generate_series(0, 63)) AS pos, list_slice(embedding, 1, 40 + label * 3) AS cut FROM embeddings),
c AS (SELECT vec_id, label, pos, CAST(cut[pos + 1] AS DOUBLE) AS x FROM v), m AS (SELECT pos, avg(x) AS m FROM c WHERE label < 5 GROUP BY pos)
SELECT vec_id, c.pos, round(coalesce(x, m, 0), 6) AS x FROM c JOIN m ON m.pos = c.pos""")
def j8(spark, d):
    e = V.table(spark, d, "embeddings").select(
        "vec_id", "label", F.slice("embedding", F.lit(1), F.lit(40) + F.col("label") * 3).cast("array<double>").alias("v"))
    out = X.pad_vectors(e, "v", 64, F.col("label") < 5)
    return out.select("vec_id", F.posexplode("v").alias("pos", "x")).select("vec_id", F.col("pos").cast("long").alias("pos"), r("x").alias("x"))


GRAMS = """t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, concat(w[i], ' ', w[i + 1]) AS gram FROM t, unnest(generate_series(1, len(w) - 1)) u(i)),
b AS (SELECT doc_id, CAST('0x' || substr(sha1(gram), 1, 12) AS BIGINT) % 256 AS bit FROM g)"""


@query("j9_hashed_presence_features", f"""WITH {GRAMS}
SELECT d.doc_id, count(DISTINCT bit) AS n_bits, coalesce(CAST(sum(DISTINCT bit) AS BIGINT), 0) AS bit_sum FROM documents d LEFT JOIN b ON b.doc_id = d.doc_id GROUP BY d.doc_id""")
def j9(spark, d):
    docs = V.table(spark, d, "documents").select("doc_id", X.hashed_presence(X.token_ngrams("text", 2), 256).alias("bits"))
    return docs.select("doc_id", F.size("bits").cast("long").alias("n_bits"),
                       F.aggregate("bits", F.lit(0).cast("long"), lambda a, x: a + x).alias("bit_sum"))


@query("j9_hashed_count_features", f"""WITH {GRAMS}
SELECT doc_id, CAST(bit AS INT) AS bit, count(*) AS n FROM b GROUP BY ALL""")
def j9b(spark, d):
    docs = V.table(spark, d, "documents").select("doc_id", "text")
    return X.hashed_counts(docs, ["doc_id"], X.token_ngrams("text", 2), 256)


@query("j12_one_hot_groups", """
SELECT c_custkey, CAST(c_mktsegment = 'BUILDING' AS INT) AS seg_building, CAST(c_mktsegment = 'HOUSEHOLD' AS INT) AS seg_household FROM customer""")
def j12(spark, d):
    c = V.table(spark, d, "customer").select("c_custkey", F.lower("c_mktsegment").alias("s"))
    return X.one_hot(c, "s", ["building", "household"], "seg_").drop("s")


# --- L: applicability domain ---------------------------------------------------------------------------------------

SCALED = """st AS (SELECT pos, avg(x) AS m, stddev_pop(x) AS s FROM v_long WHERE label < 5 GROUP BY pos),
z AS (SELECT v.vec_id, v.label, list((x - m) / s ORDER BY v.pos) AS f FROM v_long v JOIN st ON st.pos = v.pos GROUP BY v.vec_id, v.label)"""


def domain_sides(spark, d):
    e = V.table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("features"))
    return e.where("label < 5").drop("label"), e.where("label >= 5").drop("label")


@query("l1_knn_novelty", f"""WITH {SCALED},
tt AS (SELECT a.vec_id, list_distance(a.f, b.f) AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.f, b.f), b.vec_id) AS rk
 FROM z a JOIN z b ON a.label < 5 AND b.label < 5),
th AS (SELECT quantile_cont(m, 0.95) AS t FROM (SELECT vec_id, avg(d) AS m FROM tt WHERE rk BETWEEN 2 AND 6 GROUP BY vec_id)),
qt AS (SELECT a.vec_id, list_distance(a.f, b.f) AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.f, b.f), b.vec_id) AS rk
 FROM z a JOIN z b ON a.label >= 5 AND b.label < 5)
SELECT vec_id, round(avg(d), 6) AS mean_distance, round(max(t), 6) AS threshold, avg(d) <= max(t) AS in_domain FROM qt CROSS JOIN th WHERE rk <= 5 GROUP BY vec_id""", ("v_long",))
def l1(spark, d):
    train, q = domain_sides(spark, d)
    ref = D.fit_domain(train, "vec_id", methods=["knn"])
    a = D.assess_domain(q, ref, "vec_id")
    return a.select("vec_id", r("ad_knn_mean_distance").alias("mean_distance"), F.lit(round(ref.knn_threshold, 6)).alias("threshold"),
                    F.col("ad_knn_in_domain").alias("in_domain"))


@query("c13_nearest_neighbour_join", """
WITH k AS (SELECT a.vec_id, b.vec_id AS neighbour_id, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d FROM embeddings a JOIN embeddings b
 ON a.label >= 5 AND b.label < 5), o AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, neighbour_id) AS rk FROM k)
SELECT vec_id, neighbour_id, round(d, 6) AS distance, CAST(rk AS INT) AS neighbour_rank FROM o WHERE rk <= 3""")
def c13(spark, d):
    train, q = domain_sides(spark, d)
    return rounded(N.nearest_neighbours(q, train, "vec_id", "vec_id", "features", 3), "distance")


@query("l2_mahalanobis")
def l2(spark, d):
    train, q = domain_sides(spark, d)
    a = D.assess_domain(q, D.fit_domain(train, "vec_id", methods=["mahalanobis"]), "vec_id")
    return a.select("vec_id", r("ad_mahalanobis_distance").alias("distance"), F.col("ad_mahalanobis_in_domain").alias("in_domain"))


@query("l3_query_alignment", """
WITH m AS (SELECT pos, quantile_cont(x, 0.5) AS m FROM v_long WHERE label < 5 GROUP BY pos),
q AS (SELECT vec_id, pos, CASE WHEN abs(x) < 0.05 THEN 'nan'::DOUBLE ELSE x END AS x FROM v_long WHERE label >= 5)
SELECT q.vec_id, round(sum(CASE WHEN isnan(x) THEN m ELSE x END), 5) AS total, count(*) FILTER (isnan(x)) AS filled FROM q JOIN m ON m.pos = q.pos GROUP BY q.vec_id""", ("v_long",))
def l3(spark, d):
    train, q = domain_sides(spark, d)
    med = X.training_medians(X.to_long(train, "features"), "pos", "x")
    holes = q.withColumn("features", F.transform("features", lambda x: F.when(F.abs(x) < 0.05, float("nan")).otherwise(x)))
    n = F.size(F.filter("features", lambda x: F.isnan(x))).cast("long")
    out = X.align_to_training(holes.withColumn("filled", n), med, "features")
    return out.select("vec_id", r(F.aggregate("features", F.lit(0.0), lambda a, x: a + x), 5).alias("total"), "filled")


@query("l4_key_validity", """
SELECT doc_id, CASE WHEN source < 'src2' THEN NULL ELSE text END IS NOT NULL AS valid, CASE WHEN source < 'src2' THEN 'Invalid key' ELSE 'Valid' END AS label FROM documents""")
def l4(spark, d):
    docs = V.table(spark, d, "documents").select("doc_id", F.when(F.col("source") >= "src2", F.col("text")).alias("k"))
    ok = F.col("k").isNotNull()
    return docs.select("doc_id", ok.alias("valid"), F.when(ok, "Valid").otherwise("Invalid key").alias("label"))


@query("l5_consensus_label", """
WITH k AS (SELECT event_id, CAST(value < 50 AS INT) + CAST(user_id < 75 AS INT) + CAST(event_type = 'click' AS INT) AS s FROM events)
SELECT event_id, s AS ad_method_support_count, round(s / 3.0::DOUBLE, 6) AS ad_consensus_support_ratio, CASE WHEN s = 3 THEN 'Low concern' WHEN s = 2 THEN 'Moderate concern' ELSE 'High concern' END AS ad_consensus_concern,
 concat(CAST(s AS VARCHAR), '/3 AD methods marked this molecule in-domain.', CASE WHEN s = 3 THEN '' WHEN s = 2 THEN ' Use caution and inspect nearest-neighbor chemistry.'
 ELSE ' Treat this as likely out-of-domain and prioritize experimental confirmation.' END) AS ad_consensus_interpretation FROM k""")
def l5(spark, d):
    e = V.table(spark, d, "events").select("event_id", (F.col("value") < 50).alias("a"), (F.col("user_id") < 75).alias("b"),
                                           (F.col("event_type") == "click").alias("c"))
    out = D.with_consensus(e, ["a", "b", "c"])
    return rounded(out.select("event_id", "ad_method_support_count", "ad_consensus_support_ratio", "ad_consensus_concern",
                              "ad_consensus_interpretation"), "ad_consensus_support_ratio")


@query("l6_rule_table_interpretation", """
WITH k AS (SELECT event_id, value < 50 AS a, user_id < 75 AS b, event_type = 'click' AS c FROM events), n AS (SELECT *, CAST(a AS INT) + CAST(b AS INT) + CAST(c AS INT) AS s FROM k)
SELECT event_id, s > 0 AS in_domain_by_any_rule, s AS id_rule_count, CASE s WHEN 3 THEN 'Low concern' WHEN 2 THEN 'Moderate concern' ELSE 'High concern' END AS overall_concern,
 CASE WHEN s = 3 THEN 'All three rules marked this row in-domain.' WHEN a AND b AND NOT c THEN 'Supported by similarity and error rules, but the uncertainty calibration rule flagged caution.'
 WHEN s > 0 THEN 'Only partial support was found; use this prediction cautiously.' ELSE 'All rules flagged this row as out-of-domain.' END AS interpretation FROM n""")
def l6(spark, d):
    word = lambda c: F.when(c, "ID").otherwise("OD")
    e = V.table(spark, d, "events").select("event_id", word(F.col("value") < 50).alias("r1"), word(F.col("user_id") < 75).alias("r2"),
                                           word(F.col("event_type") == "click").alias("r3"))
    out = D.interpret_rules(e, {"residual": "r1", "rmse": "r2", "calibration": "r3"})
    return out.drop("r1", "r2", "r3")


@query("l7_threshold_metadata", """
SELECT count(*) AS n_training_chemicals, max(len(embedding)) AS n_features, 5 AS knn_neighbors, 0.95::DOUBLE AS knn_quantile, 0.975::DOUBLE AS mahalanobis_quantile,
 0.75::DOUBLE AS low_concern_support_ratio, concat('{"n_training_chemicals":', count(*), ',"n_features":', max(len(embedding)),
 ',"knn_neighbors":5,"knn_quantile":0.95,"mahalanobis_quantile":0.975,"low_concern_support_ratio":0.75}') AS metadata FROM embeddings WHERE label < 5""")
def l7(spark, d):
    return D.domain_metadata(domain_sides(spark, d)[0])


@query("j10_family_columns", """
WITH f AS (SELECT doc_id, n_chars::DOUBLE AS c, (n_chars % 7)::DOUBLE AS c7, len(string_split(text, ' '))::DOUBLE AS w, len(source)::DOUBLE AS s FROM documents)
SELECT doc_id, 4 AS n_features, 1 AS source_width, 1 AS words_width, 2 AS chars_width, w + 10 * c + 100 * c7 + 1000 * s AS checksum FROM f""")
def j10(spark, d):
    """Three families of text columns named with other spellings, repeats and an unknown one, side by side."""
    docs = V.table(spark, d, "documents")
    builders = {"chars": F.array(F.col("n_chars"), F.col("n_chars") % 7), "words": F.array(F.size(F.split("text", " ", -1))),
                "source": F.array(F.length("source"))}
    chosen = families.selected_families([" Words", "characters", "word", "none", "chars"], ["source", "chars"], builders,
                                        {"characters": "chars", "word": "words"})
    out = families.family_columns(docs, ["doc_id"], builders, chosen)
    weights = F.array(*[F.lit(10.0 ** i) for i in range(4)])
    total = F.aggregate(F.zip_with("features", weights, lambda x, w: x * w), F.lit(0.0), lambda a, x: a + x)
    return out.select("doc_id", F.size("features").alias("n_features"), *[F.col("widths")[n].alias(f"{n}_width") for n in builders],
                      total.alias("checksum"))
