"""Model-fitting queries on the nine-feature vectors (results depend on the fitted trees, so no SQL oracle)."""

from pyspark.sql import Window, functions as F

from ..operators import modeling as mo
from ..plans.registry import query
from ..sources.tables import snapshots, vectors


def labelled(spark, sf):
    """Runs are (stream, condition); half of the streams are faulty and get a shifted first feature."""
    v = vectors(spark, sf).join(snapshots(spark, sf).select("vec_id", "x"), "vec_id")
    cond = F.col("vec_id") % 4
    fault = F.col("stream") >= 5
    f = F.transform(F.concat("x", F.slice("v", 1, 12)), lambda e, i: e + F.when(fault & (i < 3), 0.8).otherwise(0.0))
    split = F.when(F.col("vec_id") % 5 < 3, "train").when(F.col("vec_id") % 5 == 3, "validation").otherwise("test")
    return v.select("vec_id", (F.col("stream") * 4 + cond).alias("run"), cond.alias("condition"), fault.alias("label"), f.alias("features"), split.alias("split"))


SIZE = {"trees": 10, "depth": 4}


@query("m01_compare_classifiers")
def m01(spark, sf):
    m = mo.compare_classifiers(labelled(spark, sf), "features", "label", "run", "split", list(mo.BUILDERS), **SIZE)
    return m.select("model", "n", "selected", F.round("recall", 3).alias("recall"), F.round("fpr", 3).alias("fpr"))


def _oof(spark, sf, specs):
    return mo.oof_scores(labelled(spark, sf), "features", "label", "run", "condition", mo.leave_one_out([0, 1, 2, 3], 2), specs, **SIZE)


@query("m02_oof_scores")
def m02(spark, sf):
    o = _oof(spark, sf, {"rf9": ("random_forest", 9), "rf21": ("random_forest", 21), "gb9": ("boosted_trees", 9), "gb21": ("boosted_trees", 21)})
    return o.groupBy("candidate", "held").agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg("score"), 3).alias("mean_score"), F.round(F.max("t_single"), 3).alias("threshold"))


@query("m03_novelty")
def m03(spark, sf):
    d = labelled(spark, sf)
    n = mo.fit_novelty(d, "features", "label", "split", 5)
    return n.score(d, "features").groupBy("split", "label").agg(F.count(F.lit(1)).alias("rows"), F.count_if("verdict").alias("flagged"), F.round(F.avg("error"), 4).alias("mean_error"))


@query("m04_policy_experiment")
def m04(spark, sf):
    summary, chosen = mo.run_policy_experiment(_oof(spark, sf, {"rf9": ("random_forest", 9), "rf21": ("random_forest", 21)}), "label", ["single", "pooled", "max_condition"], "single", 0.5, 0.9, 0.9)
    return summary.join(chosen.select("policy", F.lit(True).alias("chosen")), "policy", "left").fillna(False, ["chosen"]).select(
        "policy", "chosen", F.round("mean_recall", 3).alias("mean_recall"), F.round("mean_fpr", 3).alias("mean_fpr"))


_ROWS = "(select *, cast(label >= 5 as int) as fault, vec_id % 4 as condition from embeddings)"


@query("m04_cost_weights", f"""select 'normal_cost' || c as candidate, n, positives, 4::bigint as folds, true as one_at_most, true as floor_holds from (select unnest([1, 2, 4]) as c), (select count(*) as n, cast(sum(fault) as bigint) as positives from {_ROWS})""")
def m04_costs(spark, sf):
    """Every row is judged once for each cost; the choice obeys its gates."""
    e = mo.cost_weight_experiment(labelled(spark, sf), "features", "label", "run", "condition", mo.leave_one_out([0, 1, 2, 3], 2), ("random_forest", 21), mean_fpr=0.3, worst_fpr=0.5, recall_loss=0.3, **SIZE)
    chosen = F.count_if("selected").over(Window.partitionBy())  # three rows
    holds = ~F.col("selected") | (F.col("eligible") & (F.col("mean_recall") >= F.col("recall_floor")) & (F.col("mean_fpr") <= 0.3))
    return e.select("candidate", "n", "positives", "folds", (chosen <= 1).alias("one_at_most"), holds.alias("floor_holds"))


@query("m04_resolution", f"""select fit, domain, n, positives, true as consistent from (select unnest(['clean_fit', 'half_degraded_fit']) as fit), (select unnest(['clean', 'degraded']) as domain), (select count(*) as n, cast(sum(fault) as bigint) as positives from {_ROWS})""")
def m04_resolution(spark, sf):
    """Features rounded to a coarse step stand for windows of lower resolution; each row is judged once for each fit and domain."""
    d = labelled(spark, sf).withColumn("coarse", F.transform("features", lambda v: F.rint(v / 0.25) * 0.25))
    e = mo.resolution_experiment(d, "features", "coarse", "label", "run", "condition", "vec_id", mo.leave_one_out([0, 1, 2, 3], 1), mean_fpr=0.3, worst_fpr=0.5, recall_loss=0.3, **SIZE)
    return e.select("fit", "domain", "n", "positives", (~F.col("replaces") | ((F.col("fit") == "half_degraded_fit") & (F.col("mean_fpr") <= 0.3))).alias("consistent"))


@query("m05_evaluate_selected")
def m05(spark, sf):
    d = labelled(spark, sf)
    n = mo.fit_novelty(d, "features", "label", "split", 5, "sigma")
    metrics, cases = mo.evaluate_selected(n.score(d, "features"), "label", "split", ["vec_id"])
    return metrics.select("n", "tp", "fp", "fn", "tn", F.round("recall", 3).alias("recall"))


@query("x11_classify")
def x11(spark, sf):
    from ..operators.scoring import classify
    d = labelled(spark, sf)
    model = mo._fit(mo._prepare(d.filter("split = 'train'"), "features", "label"), "random_forest", "label", "run", **SIZE)
    return classify(d.filter("split <> 'train'"), model, "features", 0.5).select("vec_id", F.round("score", 4).alias("score"), "verdict")
