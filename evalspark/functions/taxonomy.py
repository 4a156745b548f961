"""Ordered text rules (metric names, directions, splits, families) compiled to ``when`` chains."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalspark.functions.cleaning import as_col, strip

Rule = tuple[Column, str]


def classify(rules: Sequence[Rule], default: Column | str | None = None) -> Column:
    """First matching rule wins; ``default`` otherwise."""
    out = None
    for cond, label in rules:
        cond = F.coalesce(cond, F.lit(False))
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    if default is None:
        return out
    return out.otherwise(F.lit(default) if isinstance(default, str) else default)


def low(c: Column | str) -> Column:
    return F.lower(strip(F.coalesce(as_col(c).cast("string"), F.lit(""))))


def has(text: Column, *parts: str) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | text.contains(p)
    return out


def starts(text: Column, *parts: str) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | text.startswith(p)
    return out


# Metric groups.
LOSS_METRICS = ("rmse", "mae", "mse")
CLASSIFICATION_METRICS = ("roc_auc", "auprc", "accuracy", "balanced_accuracy", "mcc")
SCORE_METRICS = ("r2", "pearson", "pearsonr", "spearman", "spearmanr", *CLASSIFICATION_METRICS)
# Datasets always scored by area under precision-recall.
AUPRC_DATASETS = (
    "tdc_cyp2c9_veith",
    "tdc_cyp2d6_veith",
    "tdc_cyp3a4_veith",
    "tdc_cyp2c9_substrate_carbonmangels",
    "tdc_cyp2d6_substrate_carbonmangels",
    "tdc_cyp3a4_substrate_carbonmangels",
)


def normalize_metric(c: Column | str, fallback: Column | str | None = "rmse") -> Column:
    """Metric spelling used for run results. Note: ``root_mean_squared_error`` reads as mse, as in published tables."""
    t = low(c)
    compact = F.regexp_replace(t, "[ _-]", "")
    return classify([
        # Spelling rules, in order.
        (compact.isin("rocauc", "auroc", "aucroc", "auc") | has(t, "roc-auc", "roc_auc"), "roc_auc"),
        (compact.isin("auprc", "prauc", "averageprecision", "avgprecision") | has(t, "pr-auc", "average precision"),
         "auprc"),
        (compact.isin("balancedaccuracy", "balacc", "bac") | has(t, "balanced accuracy"), "balanced_accuracy"),
        (compact.isin("mcc", "matthewscorrcoef", "matthewscorrelationcoefficient"), "mcc"),
        (compact.isin("accuracy", "acc"), "accuracy"),
        (has(t, "mean_squared_error") | (t == "mse"), "mse"),
        (has(t, "rmse"), "rmse"),
        (has(t, "mae"), "mae"),
        (has(t, "spearman"), "spearman"),
        (has(t, "pearson"), "pearson"),
        (t.isin("r2", "r^2"), "r2"),
    ], fallback)


def leaderboard_metric_kind(c: Column | str) -> Column:
    """Metric spelling used for reference leaderboards; unknown names are returned as they are, blank gives null."""
    t = F.translate(low(c), "- ", "__")
    return F.when(t != "", classify([
        # Spelling rules, in order.
        (has(t, "mean_squared_error") | (t == "mse") | t.endswith("_mse"), "mse"),
        (has(t, "rmse"), "rmse"),
        (has(t, "mae"), "mae"),
        (has(t, "auroc", "roc_auc", "auc_roc") | (t == "auc") | (has(t, "roc") & has(t, "auc")), "roc_auc"),
        (has(t, "auprc", "pr_auc", "auc_pr", "average_precision"), "auprc"),
        (has(t, "balanced_accuracy") | (t == "ba"), "balanced_accuracy"),
        (t.isin("accuracy", "acc") | t.endswith("_accuracy"), "accuracy"),
        ((t == "mcc") | has(t, "matthews"), "mcc"),
        (has(t, "spearman"), "spearman"),
        (has(t, "pearson"), "pearson"),
        ((t == "r_squared") | has(t, "r2", "r^2"), "r2"),
    ], t))


def metric_lower_is_better(c: Column | str) -> Column:
    """Nullable: names outside both groups have no known direction."""
    m = normalize_metric(c, low(c))
    return (F.when(m.isin(*LOSS_METRICS, "mean_squared_error", "mean_absolute_error"), F.lit(True))
            .when(m.isin(*SCORE_METRICS), F.lit(False)))


def metric_lower_by_text(c: Column | str) -> Column:
    """Direction from parts of the name; unknown and blank names count as lower-is-better."""
    t = low(c)
    loss = has(t, "rmse", "mae", "mse", "loss", "error")
    score = has(t, "accuracy", "auc", "auroc", "auprc", "mcc", "f1", "r2", "spearman", "pearson")
    return F.when(loss, True).when(score, False).otherwise(True)


def leaderboard_direction(kind: Column | str, explicit: Column | str | None = None) -> Column:
    k = as_col(kind)
    rules: list[Rule] = []
    if explicit is not None:
        t = low(explicit)
        rules += [(t.startswith("lower"), "lower"), (t.startswith("higher"), "higher")]
    rules += [(k.isin(*LOSS_METRICS), "lower"),
              (k.isin("r2", "spearman", "pearson", *CLASSIFICATION_METRICS), "higher")]
    return classify(rules, "lower")


def is_classification_metric(c: Column | str) -> Column:
    return normalize_metric(c, low(c)).isin(*CLASSIFICATION_METRICS)


def classification_metric_kind(dataset: Column | str, primary: Column | str) -> Column:
    d, t = low(dataset), low(primary)
    return classify([
        (d.isin(*AUPRC_DATASETS), "auprc"),
        (has(t, "auprc", "pr_auc", "average_precision"), "auprc"),
        (has(t, "balanced"), "balanced_accuracy"),
        (has(t, "mcc", "matthews"), "mcc"),
    ], "roc_auc")


def task_kind(primary: Column | str, rmse: Column, *class_scores: Column) -> Column:
    t = low(primary)
    looks = t.rlike("auc|accuracy|mcc|f1|auprc|average_precision")
    for s in class_scores:
        looks = looks | s.isNotNull()
    return F.when(looks, "classification").when(rmse.isNotNull(), "regression").otherwise("unknown")


def comparison_score(value: Column | str, lower_is_better: Column) -> Column:
    """Smaller is always better afterwards."""
    v = as_col(value)
    return F.when(lower_is_better, v).otherwise(-v)


def relative_improvement(base: Column | str, challenger: Column | str, lower_is_better: Column) -> Column:
    b, c = as_col(base), as_col(challenger)
    return F.when(lower_is_better, b - c).otherwise(c - b) / F.greatest(F.abs(b), F.lit(1e-12))


def normalize_split(c: Column | str, fallback: Column | str, allow_predefined: bool = False) -> Column:
    t = low(c)
    fb = F.lit(fallback) if isinstance(fallback, str) else fallback
    pre = F.lit("predefined") if allow_predefined else fb
    return (F.when(has(t, "predefined", "fixed"), pre)
            .when(has(t, "scaffold"), "scaffold").when(has(t, "random"), "random")
            .when(has(t, "strat"), "target_quartiles").otherwise(fb))


def cv_split(c: Column | str) -> Column:
    t = low(c)
    return F.when(t == "predefined", "random").otherwise(t)


def predefined_side(c: Column | str) -> Column:
    t = low(c)
    return F.when(t.isin("train", "training"), "train").when(t.isin("test", "holdout"), "test")


def clean_token(c: Column | str) -> Column:
    t = F.regexp_replace(low(c), "[^0-9a-zA-Z]+", "_")
    return F.coalesce(F.nullif(F.regexp_replace(t, "^_+|_+$", ""), F.lit("")), F.lit("unknown"))


def slugify(c: Column | str) -> Column:
    """Every character that is neither letter nor digit becomes one underscore."""
    t = F.regexp_replace(F.lower(as_col(c)), r"[^\p{L}\p{N}]", "_")
    return F.when(t == "", "dataset").otherwise(t)


def safe_name(c: Column | str, width: int = 120) -> Column:
    t = F.regexp_replace(F.regexp_replace(as_col(c), r"[^\p{L}\p{N}]", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(F.substring(t, 1, width), F.lit("")), F.lit("unknown"))


def sheet_name(target: Column, subset: Column, species: Column, sex: Column, main_subset: str, width: int = 31) -> Column:
    prefix = F.when(subset == main_subset, target).otherwise(F.concat_ws("_", target, subset))
    parts = F.concat_ws("_", prefix, clean_token(F.regexp_replace(species, "^species_", "")),
                        clean_token(F.regexp_replace(sex, "^sex_", "")))
    return F.substring(parts, 1, width)


# Suites and names of the dataset-name rule.
_PREFIXED = ("tdc_", "polaris_", "poduam_", "chemml_")
_BARE_NAMES = ("esol_delaney", "freesolv_sampl", "lipophilicity")
_TDC_SUITES = ("tdc", "adme", "tox", "absorption", "distribution", "metabolism", "excretion", "toxicity")


def reference_dataset_name(c: Column | str, suite: Column | str) -> Column:
    t = low(c)
    return (F.when(t == "", "").when(starts(t, *_PREFIXED) | t.isin(*_BARE_NAMES), t)
            .when(low(suite).isin(*_TDC_SUITES), F.concat(F.lit("tdc_"), t)).otherwise(t))


# Feature-name prefix -> family.
FEATURE_PREFIXES = {
    "morgan_bit_": "morgan",
    "ecfp6_bit_": "ecfp6",
    "fcfp6_bit_": "fcfp6",
    "layered_bit_": "layered",
    "atom_pair_bit_": "atom_pair",
    "topological_torsion_bit_": "topological_torsion",
    "rdk_path_bit_": "rdk_path",
    "maccs_bit_": "maccs",
    "rdkit_": "rdkit",
    "avalon_count_": "avalon",
    "erg_": "erg",
    "maplight_morgan_": "maplight",
    "maplight_desc_": "maplight",
    "gin_emb_": "gin_embedding",
}


def feature_family(c: Column | str, prefixes: dict[str, str] = FEATURE_PREFIXES) -> Column:
    x = F.coalesce(as_col(c), F.lit(""))
    return classify([(x.startswith(p), fam) for p, fam in prefixes.items()], "other")


def architecture_family(workflow: Column | str, model: Column | str) -> Column:
    w, m = low(workflow), low(model)
    return classify([
        # Family rules, in order.
        (has(w, "ensemble") | m.startswith("ensemble ("), "Ensemble meta-model"),
        (has(w, "cfa") | m.startswith("cfa ("), "CFA combinatorial fusion"),
        (has(w, "tabpfn") | has(m, "tabpfn"), "TabPFN foundation model"),
        (has(w, "chemprop") | has(m, "chemprop"), "Graph neural networks (Chemprop)"),
        (has(w, "maplight + gnn") | has(m, "maplight + gnn"), "Graph transfer + tabular head"),
        (has(w, "uni-mol") | has(m, "uni-mol", "unimol"), "3D foundation model"),
        (has(w, "chemml deep learning") | has(m, "chemml"), "Deep tabular neural nets"),
        (has(w, "tuned conventional"), "Tuned conventional ML"),
        (has(w, "conventional"), "Conventional ML"),
    ], "Other / unknown")


def architecture_subfamily(model: Column | str) -> Column:
    m = low(model)
    return classify([
        # Subfamily rules, in order.
        (has(m, "cmpnn"), "CMPNN"),
        (has(m, "attentivefp"), "AttentiveFP"),
        (has(m, "d-mpnn", "dmpnn"), "D-MPNN"),
        (has(m, "maplight + gnn"), "MapLight + GNN"),
        (m.startswith("cfa (") | has(m, "combinatorial fusion"), "CFA fusion"),
        (has(m, "tabpfn"), "TabPFN"),
        (has(m, "chemml mlp"), "ChemML MLP"),
        (has(m, "catboost"), "CatBoost-family"),
        (has(m, "xgboost"), "XGBoost-family"),
        (has(m, "random forest"), "RandomForest-family"),
        (has(m, "svr"), "SVR"),
        (has(m, "elasticnet"), "ElasticNet-family"),
        (m.startswith("ensemble ("), "Stacking / averaging"),
    ], as_col(model))


def publication_family(model: Column | str, workflow: Column | str) -> Column:
    m, w = low(model), low(workflow)
    return classify([
        # Publication-family rules, in order.
        (m.startswith("cfa") | has(w, "cfa"), "CFA"),
        (m.startswith("ensemble") | has(w, "ensemble"), "Ensemble"),
        (has(w, "maplight + gnn") | has(m, "maplight + gnn"), "MapLight+GNN"),
        (has(w, "chemprop") | has(m, "chemprop"), "Chemprop"),
        (has(w, "tabpfn") | has(m, "tabpfn"), "TabPFN"),
        (has(w, "chemml") | has(m, "mlp", "cnn"), "Other neural baselines"),
    ], "Conventional ML")


# Ensemble method labels, in display order.
ENSEMBLE_METHODS = ("OOF stacking", "Inverse-RMSE weighted average", "CFA fusion")


def ensemble_method(model: Column | str, workflow: Column | str) -> Column:
    """Null for rows that are no ensemble."""
    m, w = low(model), low(workflow)
    ens = m.startswith("ensemble (") | has(w, "ensemble")
    return classify([
        (m.startswith("cfa (") | has(w, "cfa"), "CFA fusion"),
        (ens & has(m, "oof stacking"), "OOF stacking"),
        (ens & has(m, "weighted average") & has(m, "inverse") & has(m, "rmse"), "Inverse-RMSE weighted average"),
        (ens, "Other ensemble"),
    ])


def component_family(model: Column | str, workflow: Column | str) -> Column:
    m, w = low(model), low(workflow)
    method = ensemble_method(model, workflow)
    return classify([
        (method == "CFA fusion", "cfa"),
        (method.isNotNull(), "ensemble"),
        (has(w, "maplight + gnn") | has(m, "maplight + gnn"), "deep_backend"),
        (has(w, "chemprop", "tabpfn", "chemml", "uni-mol", "unimol")
         | has(m, "chemprop", "tabpfn", "chemml", "uni-mol", "unimol"), "deep_backend"),
        (has(m, "maplight") | has(w, "maplight"), "maplight_classic"),
    ], "conventional_ml")


# Name parts of tree ensembles.
TREE_NAMES = ("catboost", "xgboost", "random forest", "extra trees", "histgradient", "adaboost", "lightgbm")


def is_tree_model(model: Column | str) -> Column:
    return has(low(model), *TREE_NAMES)


def is_ensemble_row(model: Column | str, workflow: Column | str) -> Column:
    m = low(model)
    return (low(workflow) == "ensemble") | (m == "ensemble") | m.startswith("ensemble (")


def stage_type(model: Column | str) -> Column:
    text = F.trim(F.coalesce(as_col(model), F.lit("")))
    m = F.lower(text)
    return classify([
        # Stage labels, in order.
        ((m == "ensemble") | m.startswith("ensemble ("), "Ensemble"),
        (m.startswith("cfa (") | (m == "cfa"), "CFA fusion"),
        (text.endswith(" GA"), "GA tuned conventional"),
        (m.startswith("chemml mlp"), "ChemML deep learning"),
        (m.startswith("chemprop v2"), "Chemprop deep learning"),
        (m.startswith("uni-mol"), "Uni-Mol deep learning"),
        (m.startswith("maplight + gnn"), "MapLight + GNN deep learning"),
    ], "Conventional ML")


def workflow_override(model: Column | str, workflow: Column | str) -> Column:
    m = low(model)
    return F.when(has(m, "tabpfn"), "TabPFN").when(m.startswith("cfa ("), "CFA").otherwise(as_col(workflow))


def error_transition(previous: Column | str, current: Column | str, clean: Callable[[Column], Column]) -> Column:
    p, c = clean(as_col(previous)), clean(as_col(current))
    return (F.when(p.isNull() & c.isNull(), "ok_both").when(p.isNull(), "new_error").when(c.isNull(), "resolved")
            .when(p == c, "persistent_same").otherwise("changed_error"))
