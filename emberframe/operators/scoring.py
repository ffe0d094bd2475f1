"""Model metrics per row, per scene and over thresholds. Undefined ratios are NULL here and averages skip them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberframe.functions.nulls import ratio
from emberframe.functions.order import cumulative, percentiles, rank_by_range
from emberframe.functions.small import by_group
from emberframe.session import cut_lineage


def counts(rows: DataFrame, by: Sequence[str] = (), truth: str = "y", pred: str = "p") -> DataFrame:
    cell = lambda t, p: F.count_if((F.col(truth) == t) & (F.col(pred) == p))
    return rows.groupBy(*by).agg(cell(1, 1).alias("tp"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(0, 0).alias("tn"))


def row_metrics(rows: DataFrame, truth: str = "y", pred: str = "p") -> DataFrame:
    table = counts(rows, (), truth, pred)
    tp, fp, fn, tn = (F.col(n) for n in ("tp", "fp", "fn", "tn"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    recall, specificity, precision = ratio(tp, tp + fn), ratio(tn, tn + fp), ratio(tp, tp + fp)
    return table.select(
        "tp", "fp", "fn", "tn", ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"), ((recall + specificity) / 2).alias("balanced_accuracy"),
        zero(precision).alias("precision"), zero(recall).alias("recall"), zero(ratio(tp * 2, tp * 2 + fp + fn)).alias("f1"),
    )


def macro_metrics(rows: DataFrame, truth: str = "y", pred: str = "p") -> DataFrame:
    """Precision, recall and F1 averaged over the classes present on either side."""
    both = rows.select(F.col(truth).cast("string").alias("t"), F.col(pred).cast("string").alias("q"))
    each = both.select(F.explode(F.array_distinct(F.array("t", "q"))).alias("c"), "t", "q").groupBy("c").agg(
        F.count_if((F.col("t") == F.col("c")) & (F.col("q") == F.col("c"))).alias("tp"),
        F.count_if((F.col("t") != F.col("c"))).alias("fp"), F.count_if((F.col("q") != F.col("c"))).alias("fn"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return each.agg(
        F.avg(zero(ratio(tp, tp + fp))).alias("macro_precision"), F.avg(zero(ratio(tp, tp + fn))).alias("macro_recall"),
        F.avg(zero(ratio(tp * 2, tp * 2 + fp + fn))).alias("macro_f1"), F.count("*").alias("n_classes"),
    )


def average_precision(rows: DataFrame, by: Sequence[str] = (), truth: str = "y", score: str = "score") -> DataFrame:
    """Sum of (R_n - R_n-1) P_n over falling scores, equal scores taken together.

    R_n - R_n-1 is the share of positives at score n, so each distinct score adds tp_n / positives * precision_n.
    """
    groups = list(by) or ["_one"]
    rows = rows if by else rows.withColumn("_one", F.lit(0))
    graded = cut_lineage(rows.groupBy(*groups, score).agg(F.sum(F.col(truth).cast("long")).alias("_tp"), F.count("*").alias("_n")))
    total = graded.groupBy(*groups).agg(F.sum("_tp").alias("_pos"))
    run = by_group(cumulative(graded, groups, score, ["_tp", "_n"], descending=True), total, groups, F.col(score))
    part = ratio(F.col("_tp"), F.col("_pos")) * F.col("cum__tp") / F.col("cum__n")
    return run.groupBy(*groups).agg(F.sum(part).alias("average_precision")).drop("_one")


def scene_scores(rows: DataFrame, truth: str = "y", pred: str = "p") -> DataFrame:
    """Per scene: counts, whether it burns, whether an alarm was raised, and ratios that are NULL when undefined."""
    table = counts(rows, ["scene"], truth, pred)
    tp, fp, fn, tn = (F.col(n) for n in ("tp", "fp", "fn", "tn"))
    table = table.withColumns({
        "n_rows": tp + fp + fn + tn, "has_fire": tp + fn > 0, "alarm": tp + fp > 0,
        "recall": ratio(tp, tp + fn), "precision": ratio(tp, tp + fp),
    })
    nothing = ~F.col("has_fire") & ~F.col("alarm")
    f1 = F.when(~nothing, F.coalesce(ratio(tp * 2, tp * 2 + fp + fn), F.lit(0.0)))
    return table.withColumn("f1", f1)


def scene_aggregates(scenes: DataFrame, recall_target: float) -> DataFrame:
    """Every scene weighs the same whatever its size."""
    fire, alarm, fp = F.col("has_fire"), F.col("alarm"), F.col("fp")
    share = lambda c: F.avg(c.cast("double"))
    table = scenes.agg(
        F.count("*").alias("scene_count"), F.count_if(fire).alias("with_fire"), F.count_if(~fire).alias("without_fire"),
        F.avg(F.when(fire, F.col("recall"))).alias("macro_recall"), F.avg("precision").alias("macro_precision"),
        F.min(F.when(fire, F.col("recall"))).alias("worst_recall"), share(F.when(fire, F.col("recall") >= recall_target)).alias("meeting_target"),
        F.avg(fp).alias("fp_per_scene"), F.max(fp).alias("fp_max"), F.avg(F.when(~fire, fp)).alias("fp_per_clear_scene"),
        share(F.when(fire, alarm)).alias("alarm_recall"), share(F.when(alarm, fire)).alias("alarm_precision"),
        F.count_if(~fire & alarm).alias("false_alarm_scenes"), F.count_if(fire & ~alarm).alias("missed_scenes"),
        share(F.when(fire, F.col("tp") > 0)).alias("hit_recall"), F.count_if(fire & (F.col("tp") == 0)).alias("hit_missed"),
    )
    p, r = F.col("alarm_precision"), F.col("alarm_recall")
    table = table.withColumn("alarm_f1", ratio(p * r * 2, p + r)).withColumn("recall_target", F.lit(recall_target))
    return table.join(F.broadcast(percentiles(scenes, [], "fp", {"fp_median": 0.5})))  # one row each


def choose_threshold(rows: DataFrame, recall_target: float, truth: str = "y", score: str = "score", low: float = 0.05, step: float = 0.01,
                     n: int = 91) -> DataFrame:
    """Mean scene recall and precision per threshold; `chosen` is the highest that meets the target, else the best recall.

    A row is counted once, at the highest threshold it reaches; running sums over the fixed list give every threshold.
    """
    from pyspark.sql import Window as W

    reached = F.least(F.floor((F.col(score) - low) / step + 1e-9), F.lit(n - 1))
    graded = rows.groupBy("scene", reached.cast("int").alias("_at")).agg(
        F.sum(F.col(truth).cast("long")).alias("_tp"), F.count("*").alias("_n")
    )
    positives = rows.groupBy("scene").agg(F.sum(F.col(truth).cast("long")).alias("_pos"))
    frame = positives.withColumn("_at", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    run = W.partitionBy("scene").orderBy(F.desc("_at")).rowsBetween(W.unboundedPreceding, 0)
    # At most n rows a scene here, whatever the scene's size.
    full = frame.join(graded, ["scene", "_at"], "left").withColumns({
        "tp": F.sum(F.coalesce("_tp", F.lit(0))).over(run), "n_pred": F.sum(F.coalesce("_n", F.lit(0))).over(run),
    })
    table = full.groupBy("_at").agg(
        F.avg(ratio(F.col("tp"), F.col("_pos"))).alias("recall"), F.avg(ratio(F.col("tp"), F.col("n_pred"))).alias("precision")
    ).withColumn("threshold", F.round(F.col("_at") * step + low, 2))
    pick = table.agg(
        F.max(F.when(F.col("recall") >= recall_target, F.col("threshold"))).alias("_ok"), F.max_by("threshold", F.struct("recall", "threshold")).alias("_best")
    )
    return table.join(F.broadcast(pick)).withColumn("chosen", F.col("threshold") == F.coalesce("_ok", "_best")).select(
        "threshold", "recall", "precision", "chosen"
    )


def run_metrics(runs: DataFrame, document: str = "document", sections: Sequence[str] = ("global", "scene_level")) -> DataFrame:
    """(run, metric, value) of metric documents of any shape, given as VARIANT: the numbers of each section by name.

    Where sections share a name the later one counts. What is no number is left out, as are documents that lack a section or have
    something else in its place. A run name comes once.
    """
    entries = None
    for rank, section in enumerate(sections):
        part = runs.select("run", F.try_variant_get(document, f"$.{section}", "map<string, variant>").alias("m"))
        part = part.select("run", F.lit(rank).alias("section"), F.explode("m").alias("metric", "entry"))
        entries = part if entries is None else entries.unionByName(part)
    kind = F.schema_of_variant("entry")
    number = F.when(~kind.isin("STRING", "BOOLEAN", "VOID"), F.try_variant_get("entry", "$", "double"))
    return entries.withColumn("value", number).groupBy("run", "metric").agg(F.max_by("value", "section").alias("value")).where("value is not null")


def compare_runs(metrics: DataFrame, columns: dict[str, str], sort: str, digits: int = 3) -> DataFrame:
    """One row per run of (run, metric, value): the metrics that `columns` names, under its short names, rounded; absent ones are NULL.

    `place` counts runs by falling `sort` (a name of a metric), runs without it last, equal ones by name.
    """
    if sort not in columns:
        raise ValueError(f"sorted by {sort!r}, which is not among the columns")
    wide = metrics.groupBy("run").agg(*[F.max(F.when(F.col("metric") == name, F.col("value"))).alias(short) for name, short in columns.items()])
    ranked = rank_by_range(wide, [F.desc_nulls_last(columns[sort]), F.asc("run")], "place")
    return ranked.select("run", "place", *[F.round(short, digits).alias(short) for short in columns.values()])


def dry_edge(rows: DataFrame, x: str, y: str, bins: int = 50) -> DataFrame:
    """Index of `y` between a fitted dry edge and a constant wet edge over binned `x`, clipped to 0..1."""
    clean = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    bounds = clean.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))  # one row
    placed = clean.join(F.broadcast(bounds))
    at = F.ceil((F.col(x) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins) - 1
    placed = placed.withColumn("_bin", F.greatest(at, F.lit(0)).cast("int"))
    edges = percentiles(placed, ["_bin"], y, {"dry": 0.98, "wet": 0.02}).join(F.broadcast(bounds))
    centre = F.col("_lo") + (F.col("_bin") + 0.5) * (F.col("_hi") - F.col("_lo")) / bins
    line = edges.withColumn("_x", centre).agg(
        F.regr_slope("dry", "_x").alias("slope"), F.regr_intercept("dry", "_x").alias("intercept"), F.avg("wet").alias("wet")
    )
    out = placed.drop("_lo", "_hi", "_bin").join(F.broadcast(line))
    top = F.col("intercept") + F.col("slope") * F.col(x)
    return out.withColumn("index", F.least(F.greatest(ratio(F.col(y) - F.col("wet"), top - F.col("wet")), F.lit(0.0)), F.lit(1.0)))
