"""Model fitting and policy experiments as Spark ML jobs."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from ..session import cut
from .aggregates import (binary_metrics, choose_policy, error_cases, fold_summary, grouped_metrics, quantile_higher,
                         run_weights, sigma_threshold)

# registry of estimator builders by kind; tree settings kept small enough for repeated folds
BUILDERS = {
    "random_forest": lambda trees=100, depth=8: RandomForestClassifier(featuresCol="__x", labelCol="__y", weightCol="weight", numTrees=trees,
                                                                      maxDepth=depth, minInstancesPerNode=3, featureSubsetStrategy="sqrt", seed=42),
    "boosted_trees": lambda trees=50, depth=4: GBTClassifier(featuresCol="__x", labelCol="__y", weightCol="weight", maxIter=trees, maxDepth=depth,
                                                            stepSize=0.05, minInstancesPerNode=20, seed=42),
}


def _prepare(df: DataFrame, features: str, label: str, width: int | None = None) -> DataFrame:
    v = F.col(features) if width is None else F.slice(features, 1, width)
    return df.withColumns({"__x": array_to_vector(v), "__y": F.col(label).cast("double")})


def _fit(train: DataFrame, kind: str, label: str, run: str, cost: float = 1.0, **size):
    # a fit reads its rows several times; their weights are joined once
    return BUILDERS[kind](**size).fit(cut(run_weights(train, label, run, cost).select("__x", "__y", "weight")))


def _score(model, df: DataFrame) -> DataFrame:
    return model.transform(df).withColumn("score", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")


def compare_classifiers(df: DataFrame, features: str, label: str, run: str, split: str, kinds: list[str], **size) -> DataFrame:
    """Fit each kind on train, set its q99 threshold on validation normals, judge it on validation, mark the choice.

    Test rows are never read.  Order: balanced accuracy, recall, lower FPR, name.
    """
    data = cut(_prepare(df.filter(F.col(split).isin("train", "validation")), features, label))
    train, held = data.filter(F.col(split) == "train"), data.filter(F.col(split) == "validation")
    out = None
    for kind in kinds:
        scored = cut(_score(_fit(train, kind, label, run, **size), held).select(label, run, "score"))
        t = quantile_higher(scored.filter(~F.col(label)), [], "score", 0.99, 1e-3).first()["threshold"]
        m = binary_metrics(scored.withColumn("model", F.lit(kind)), ["model"], F.col(label), F.col("score") > t).withColumn("threshold", F.lit(t))
        out = m if out is None else out.unionByName(m)
    best = out.orderBy(F.col("balanced_accuracy").desc(), F.col("recall").desc(), "fpr", "model").limit(1).select("model", F.lit(True).alias("selected"))
    return out.join(best, "model", "left").fillna(False, ["selected"])


def oof_scores(df: DataFrame, features: str, label: str, run: str, condition: str, folds: list[tuple], specs: dict[str, tuple[str, int]],
               cost: float = 1.0, calibration_features: str | None = None, **size) -> DataFrame:
    """Out-of-fold scores with a threshold calibrated per fold and candidate.

    ``folds``: (held, calibration list); ``specs``: name -> (kind, leading feature count).  Each fit is a Spark job; only
    folds and specs are looped on the driver.  Scores, and thresholds, of all of them are one job.
    """
    base, calibrated, out = cut(df), None, None
    for held, calibration in folds:
        fit = cut(run_weights(base.filter(~F.col(condition).isin([held, *calibration])), label, run, cost).select(features, label, "weight"))
        for name, (kind, width) in specs.items():
            model, data = BUILDERS[kind](**size).fit(_prepare(fit, features, label, width)), _prepare(base, features, label, width)
            own = {"candidate": F.lit(name), "held": F.lit(held)}
            cal = _score(model, data.filter(F.col(condition).isin(calibration) & ~F.col(label))).withColumns({**own, "first": F.col(condition) == calibration[0]})
            cal = cal.select("candidate", "held", F.col(condition).alias("condition"), "first", "score")
            scored = _score(model, data.filter(F.col(condition) == held)).drop("__x", "__y").withColumns(own)
            calibrated, out = (cal, scored) if out is None else (calibrated.unionByName(cal), out.unionByName(scored))
    thresholds = fold_thresholds(cut(calibrated), ["candidate", "held"])
    if thresholds.filter("t_single is not null").count() < len(folds) * len(specs):
        raise ValueError("a fold holds no normal calibration rows of its first condition")
    return cut(out.join(F.broadcast(thresholds), ["candidate", "held"]).select(*out.columns, "t_single", "t_pooled", "t_max_condition"))


def fold_thresholds(normal: DataFrame, by: list[str], q: float = 0.99, step: float = 1e-3) -> DataFrame:
    """For each group: t_single, t_pooled and t_max_condition (see ``normal_threshold``) of normal rows with condition, first and score.

    All folds are ranked together, as one job each would cost more than its rows.
    """
    each = quantile_higher(normal, [*by, "condition", "first"], "score", q, step)
    wide = each.groupBy(*by).agg(F.max(F.when(F.col("first"), F.col("threshold"))).alias("t_single"), F.max("threshold").alias("t_max_condition"))
    return cut(wide.join(quantile_higher(normal, by, "score", q, step).withColumnRenamed("threshold", "t_pooled"), by))


def leave_one_out(conditions: list, calibration: int = 1) -> list[tuple]:
    names = sorted(conditions)
    n = len(names)
    ahead = [1] if calibration == 1 else [1, 1 + n // 2]
    return [(h, [names[(i + a) % n] for a in ahead]) for i, h in enumerate(names)]


def run_policy_experiment(oof: DataFrame, label: str, policies: list[str], baseline: str, mean_fpr: float, worst_fpr: float, recall_loss: float) -> tuple[DataFrame, DataFrame]:
    """Fold summary per policy over out-of-fold scores, and the gated choice."""
    e = oof.withColumn("p", F.explode(F.array(*[F.struct(F.lit(p).alias("policy"), F.col(f"t_{p}").alias("threshold")) for p in policies])))
    e = e.select("*", "p.policy", "p.threshold").drop("p")
    per_fold = binary_metrics(e, ["policy", "held"], F.col(label), F.col("score") > F.col("threshold"))
    summary = fold_summary(per_fold, ["policy"])
    return summary, choose_policy(summary, "policy", baseline, mean_fpr, worst_fpr, recall_loss)


def cost_weight_experiment(df: DataFrame, features: str, label: str, run: str, condition: str, folds: list[tuple], spec: tuple[str, int], costs: tuple[float, ...] = (1, 2, 4),
                           mean_fpr: float = 0.03, worst_fpr: float = 0.10, recall_loss: float = 0.05, **size) -> DataFrame:
    """Refit with normal rows weighted by each cost; judged out of fold at the highest condition's q99 threshold.

    The recall floor is the mean recall of cost 1 at the first condition's threshold less ``recall_loss``, so a weaker
    candidate never lowers it.  Of those inside all gates the one with the highest mean recall, lowest mean FPR and first
    name is ``selected``; none may be.
    """
    if 1 not in costs:
        raise ValueError("cost 1 is the matched control")
    scored = None
    for cost in costs:
        one = oof_scores(df, features, label, run, condition, folds, {f"normal_cost{cost}": spec}, float(cost), **size)
        scored = one if scored is None else scored.unionByName(one)
    at = lambda d, t: binary_metrics(d, ["candidate", "held"], F.col(label), F.col("score") > F.col(t))
    folds_of = at(scored, "t_max_condition")
    floor = fold_summary(at(scored.where("candidate = 'normal_cost1'"), "t_single"), ["candidate"]).first()["mean_recall"] - recall_loss
    counts = folds_of.groupBy("candidate").agg(F.sum("n").alias("n"), F.sum(F.col("tp") + F.col("fn")).alias("positives"), F.count(F.lit(1)).alias("folds"))
    inside = (F.col("mean_fpr") <= mean_fpr) & (F.col("worst_fpr") <= worst_fpr) & (F.col("mean_recall") >= floor)
    out = cut(fold_summary(folds_of, ["candidate"]).withColumns({"recall_floor": F.lit(floor), "eligible": inside}).join(counts, "candidate"))
    best = out.where("eligible").orderBy(F.col("mean_recall").desc(), "mean_fpr", "candidate").limit(1).select("candidate", F.lit(True).alias("selected"))
    return out.join(best, "candidate", "left").fillna(False, ["selected"])


def resolution_experiment(df: DataFrame, clean: str, degraded: str, label: str, run: str, condition: str, index: str, folds: list[tuple], kind: str = "random_forest",
                          mean_fpr: float = 0.03, worst_fpr: float = 0.10, recall_loss: float = 0.05, **size) -> DataFrame:
    """Features of full and of lower resolution fed to two fits: on clean rows, and with even ``index`` rows degraded.

    Thresholds come from clean normal rows of the calibration condition for both.  The half-degraded fit ``replaces`` the
    clean one only if both domains stay inside the gates and, on degraded rows, its FPR falls without a loss of recall.
    One row a fit and domain.
    """
    base, out = cut(_prepare(df, clean, label).withColumnRenamed("__x", "__clean").withColumn("__degraded", array_to_vector(degraded))), None
    calibrated = None
    for held, calibration in folds:
        fit = cut(run_weights(base.filter(~F.col(condition).isin([held, *calibration])), label, run).select("__y", "weight", "__clean", "__degraded", index))
        test = base.filter(F.col(condition) == held)
        for policy in ("clean_fit", "half_degraded_fit"):
            x = F.col("__clean") if policy == "clean_fit" else F.when(F.col(index) % 2 == 0, F.col("__degraded")).otherwise(F.col("__clean"))
            model = BUILDERS[kind](**size).fit(fit.withColumn("__x", x))
            own = [F.lit(policy).alias("fit"), F.lit(held).alias("held")]
            cal = _score(model, base.filter(F.col(condition).isin(calibration) & ~F.col(label)).withColumn("__x", F.col("__clean"))).select(*own, "score")
            calibrated = cal if calibrated is None else calibrated.unionByName(cal)
            for domain in ("clean", "degraded"):
                one = _score(model, test.withColumn("__x", F.col(f"__{domain}"))).select(F.col(label).alias("label"), "score", F.lit(domain).alias("domain"), *own)
                out = one if out is None else out.unionByName(one)
    thresholds = cut(quantile_higher(cut(calibrated), ["fit", "held"], "score", 0.99, 1e-3))
    if thresholds.count() < 2 * len(folds):
        raise ValueError("a fold holds no normal calibration rows")
    out = out.join(F.broadcast(thresholds), ["fit", "held"]).withColumn("hit", F.col("score") > F.col("threshold"))
    folds_of = cut(binary_metrics(out, ["fit", "domain", "held"], F.col("label"), F.col("hit")))
    counts = folds_of.groupBy("fit", "domain").agg(F.sum("n").alias("n"), F.sum(F.col("tp") + F.col("fn")).alias("positives"))
    rows = cut(fold_summary(folds_of, ["fit", "domain"]).join(counts, ["fit", "domain"]))
    m = {(r["fit"], r["domain"]): r for r in rows.collect()}  # four rows
    floor = m["clean_fit", "clean"]["mean_recall"] - recall_loss
    new, old = m["half_degraded_fit", "degraded"], m["clean_fit", "degraded"]
    inside = all(m["half_degraded_fit", d]["mean_fpr"] <= mean_fpr and m["half_degraded_fit", d]["worst_fpr"] <= worst_fpr and m["half_degraded_fit", d]["mean_recall"] >= floor for d in ("clean", "degraded"))
    better = inside and new["mean_fpr"] < old["mean_fpr"] and new["mean_recall"] >= old["mean_recall"]
    return rows.withColumn("replaces", (F.col("fit") == "half_degraded_fit") & F.lit(better))


def select_candidate(oof: DataFrame, label: str, widths: dict[str, int]) -> DataFrame:
    """Best candidate: mean balanced accuracy, lower worst FPR, fewer features, name."""
    m = binary_metrics(oof, ["candidate", "held"], F.col(label), F.col("score") > F.col("t_single"))
    width = F.coalesce(*[F.when(F.col("candidate") == n, F.lit(w)) for n, w in widths.items()])
    return fold_summary(m, ["candidate"]).withColumn("width", width).orderBy(F.col("mean_balanced").desc(), "worst_fpr", "width", "candidate").limit(1)


class Novelty:
    """Scaler and principal axes of normal rows; the score is the mean squared residual of the scaled row."""

    def __init__(self, pipeline, threshold: float, k: int):
        self.pipeline, self.threshold, self.k = pipeline, threshold, k

    def score(self, df: DataFrame, features: str) -> DataFrame:
        t = self.pipeline.transform(df.withColumn("__x", array_to_vector(features)))
        axes = self.pipeline.stages[1].pc.toArray().T.tolist()
        t = t.withColumns({"__z": vector_to_array("__scaled"), "__p": vector_to_array("__pca")})
        residual = F.col("__z")
        for i, axis in enumerate(axes):
            w = F.col("__p")[i]
            residual = F.zip_with(residual, F.transform(F.array(*[F.lit(a) for a in axis]), lambda a: a * w), lambda r, p: r - p)
        t = t.withColumn("__r", residual).withColumn("error", F.aggregate("__r", F.lit(0.0), lambda s, v: s + v * v) / F.size("__r"))
        return t.select(*df.columns, "error", (F.col("error") > self.threshold).alias("verdict"))


def fit_novelty(df: DataFrame, features: str, label: str, split: str, k: int, rule: str = "quantile") -> Novelty:
    """Fit on train normals; threshold from validation normals: 0.99 ``higher`` quantile or mean + 3 sigma."""
    normal = df.filter(~F.col(label))
    stages = [StandardScaler(inputCol="__x", outputCol="__scaled", withMean=True, withStd=True), PCA(k=k, inputCol="__scaled", outputCol="__pca")]
    fitted = Pipeline(stages=stages).fit(normal.filter(F.col(split) == "train").withColumn("__x", array_to_vector(features)))
    probe = Novelty(fitted, float("inf"), k)
    held = cut(probe.score(normal.filter(F.col(split) == "validation"), features))
    t = (quantile_higher(held, [], "error", 0.99, 0.01) if rule == "quantile" else sigma_threshold(held, [], "error")).first()
    if t is None or t["threshold"] is None:
        raise ValueError("validation holds no normal rows")
    return Novelty(fitted, float(t["threshold"]), k)


def evaluate_selected(scored: DataFrame, label: str, split: str, order: list[str], cases: int = 10) -> tuple[DataFrame, DataFrame]:
    """Open the test split once for the selected candidate: metrics and first error cases."""
    test = cut(scored.filter(F.col(split) == "test").withColumn("model", F.lit("selected")))
    return binary_metrics(test, ["model"], F.col(label), F.col("verdict")), error_cases(test, "model", order, F.col(label), F.col("verdict"), cases)
