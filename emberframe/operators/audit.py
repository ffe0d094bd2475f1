"""Audit of a detection product against a reference mask.

Every table here comes from counts of pixels, so all of them aggregate before they shuffle. Precision and recall have two
conventions: `scores` gives 0 for an undefined ratio, `scene_scores` (operators.scoring) gives NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberframe import codes as k
from emberframe.functions.nulls import holds, ratio
from emberframe.functions.radiometry import BandCoefficients, temperature_of
from emberframe.functions.order import hash_order, medians, percentiles

COUNTS = ("tp", "fp", "fn", "tn")
SCENE = ("region", "scene")
MARGINS = (
    "mg_absdiff_vs_2K", "mg_d714_vs_std_7b14b", "mg_d7bkg_vs_std_7b", "mg_refl_vs_std_reflb", "mg_refl_vs_std_reflb_max",
    "mg_reflmreflb_vs_std_reflb_max", "mg_bt14_vs_bkg14_minus20",
)


def is_fire(code: Column) -> Column:
    return code.isin(*k.FIRE_CODES)


def base_code(code: Column) -> Column:
    return F.when(code.isin(*k.TEMPORAL_FIRE_CODES), code - k.TEMPORAL_OFFSET).otherwise(code)


def count_columns(ref: Column, pred: Column) -> list[Column]:
    pairs = {"tp": ref & pred, "fp": ~ref & pred, "fn": ref & ~pred, "tn": ~ref & ~pred}
    return [F.count_if(c).alias(n) for n, c in pairs.items()]


def scores(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1 from tp, fp, fn, tn; 0 where undefined."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    out = counts.withColumns({
        "support_ref": tp + fn, "support_pred": tp + fp,
        "precision": zero(ratio(tp, tp + fp)), "recall": zero(ratio(tp, tp + fn)),
    })
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", zero(ratio(p * r * 2, p + r)))


def binary_scores(px: DataFrame, ref: Column, pred: Column, by: Sequence[str] = ()) -> DataFrame:
    return scores(px.groupBy(*by).agg(*count_columns(ref, pred)))


def rollup_scores(px: DataFrame, ref: Column, pred: Column, by: Sequence[str] = SCENE) -> DataFrame:
    """Inside the region of interest: scores per scene and, in the row with `is_total`, over the sum of the counts."""
    table = px.where("in_roi").groupingSets([list(by), []], *by).agg(*count_columns(ref, pred), F.grouping(by[0]).alias("is_total"))
    return scores(table)


def one_vs_rest(px: DataFrame, ref: Column, pred: Column, codes: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """Scores per code inside the region of interest. A pixel counts for at most its two codes, so none is crossed with the code list."""
    px = px.where("in_roi").select(*by, ref.alias("_r"), pred.alias("_p"))
    size = px.groupBy(*by).agg(F.count("*").alias("_n"))
    hits = px.select(
        *by, F.explode(F.array_distinct(F.array("_r", "_p"))).alias("code"), "_r", "_p"
    ).where(F.col("code").isin(*codes))
    hits = hits.groupBy(*by, "code").agg(
        F.count_if((F.col("_r") == F.col("code")) & (F.col("_p") == F.col("code"))).alias("tp"),
        F.count_if((F.col("_r") != F.col("code")) & (F.col("_p") == F.col("code"))).alias("fp"),
        F.count_if((F.col("_r") == F.col("code")) & (F.col("_p") != F.col("code"))).alias("fn"),
    )
    # One row per group and code of the fixed list.
    frame = size.withColumn("code", F.explode(F.array(*[F.lit(c) for c in codes])))
    table = frame.join(hits, [*by, "code"], "left").fillna(0, ["tp", "fp", "fn"])
    table = table.withColumn("tn", F.col("_n") - F.col("tp") - F.col("fp") - F.col("fn")).drop("_n")
    return scores(table)


def confusion(px: DataFrame, ref: str = "ref_code", pred: str = "final_code") -> DataFrame:
    either = is_fire(F.col(ref)) | is_fire(F.col(pred))
    return px.where(F.col("in_roi") & either).groupBy(ref, pred).agg(F.count("*").alias("n"))


def confusion_matrix(px: DataFrame, codes: Sequence[int], ref: str = "ref_code", pred: str = "final_code") -> DataFrame:
    return px.where(F.col("in_roi") & (is_fire(F.col(ref)) | is_fire(F.col(pred)))).groupBy(ref).pivot(pred, list(codes)).count().fillna(0)


def without_low_probability(px: DataFrame) -> DataFrame:
    """Pixels with base code 15 on neither side."""
    low = lambda name: base_code(F.col(name)) == 15
    return px.where(~(low("ref_code") | low("final_code")))


def scene_metrics(px: DataFrame) -> DataFrame:
    """Inside the region: part I, part II and their variants without code 15, per scene and in total, in one pass."""
    px = px.where("in_roi")
    low = (base_code(F.col("ref_code")) == 15) | (base_code(F.col("final_code")) == 15)
    ref, p1, p2 = is_fire(F.col("ref_code")), F.col("candidate"), is_fire(F.col("final_code"))
    kinds = [("part1", p1, F.lit(True)), ("part2", p2, F.lit(True)), ("part1_no_low", p1, ~low), ("part2_no_low", p2, ~low)]
    # The variants are columns of one aggregation, then rows.
    aggs = []
    for name, pred, keep in kinds:
        for count, cond in {"tp": ref & pred, "fp": ~ref & pred, "fn": ref & ~pred, "tn": ~ref & ~pred}.items():
            aggs.append(F.count_if(cond & keep).alias(f"{name}__{count}"))
    wide = px.groupingSets([list(SCENE), []], *SCENE).agg(*aggs, F.grouping("scene").alias("is_total"))
    rows = F.array(*[
        F.struct(F.lit(n).alias("variant"), *[F.col(f"{n}__{c}").alias(c) for c in COUNTS]) for n, _, _ in kinds
    ])
    return scores(wide.select(*SCENE, "is_total", F.inline(rows)))


def recall_funnel(px: DataFrame) -> DataFrame:
    """Reference fires of the region of interest by the stage that stopped them, split by mask code and by flag (grouping sets)."""
    fires = px.where(F.col("in_roi") & is_fire(F.col("ref_code")))
    return fires.groupingSets(
        [["stage"], ["stage", "p1_code"], ["stage", "fail_char"]], "stage", "p1_code", "fail_char"
    ).agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


def stage_counts(px: DataFrame) -> DataFrame:
    return px.groupBy("stage").agg(F.count("*").alias("n"))


def gate_name(stage: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in k.STAGE_GATES.items() for x in pair])
    return names[stage]


def false_positives(px: DataFrame) -> DataFrame:
    """False positives by predicted code, reference code and flag (grouping sets)."""
    wrong = px.where(is_fire(F.col("final_code")) & ~is_fire(F.col("ref_code")))
    return wrong.groupingSets(
        [["final_code"], ["ref_code"], ["flag"]], "final_code", "ref_code", "flag"
    ).agg(F.count("*").alias("n"))


def background_summary(px: DataFrame) -> DataFrame:
    """Which background won, with median spreads, for pixels with a background and for candidates."""
    kinds = F.when(F.col("candidate"), F.array(F.lit("candidates"), F.lit("with_background"))).otherwise(F.array(F.lit("with_background")))
    both = px.where("half_width is not null").withColumn("population", F.explode(kinds))
    counts = both.groupBy("population").agg(
        F.count("*").alias("n"), F.count_if(F.col("approach") == "stat").alias("n_stat"), F.count_if(F.col("approach") == "hist").alias("n_hist")
    )
    columns = ("t7_stat_std", "t7_hist_std", "n_hist")
    found = medians(both, ["population"], columns).withColumnsRenamed({c: f"median_{c}" for c in columns})
    return counts.join(found, "population", "left")


def half_width_counts(px: DataFrame) -> DataFrame:
    return px.where("half_width is not null").groupBy("half_width").agg(
        F.count("*").alias("with_background"), F.count_if("candidate").alias("candidates")
    )


def part_two_paths(px: DataFrame) -> DataFrame:
    c = F.col
    kept = c("elim_reason").isNull()
    return px.where("candidate").agg(
        F.count("*").alias("n_candidates"), F.count("elim_reason").alias("n_eliminated"), F.count_if("confirmed").alias("n_confirmed"),
        F.count_if(kept & c("policy_rejected").isNotNull()).alias("policy_rejected"),
        *[F.count_if(c("elim_reason") == r).alias(r) for r in ("cond1", "cond2", "cond3")],
        F.count_if(kept & c("glint_edge")).alias("glint_edge"), F.count_if(kept & c("fog_edge")).alias("fog_edge"),
        *[F.count_if(kept & (c("upgraded") == u)).alias(f"upgraded_{u}") for u in (13, 14, 15)],
        F.count_if("temporally_filtered").alias("temporally_filtered"),
    )


def final_codes(px: DataFrame) -> DataFrame:
    """Final codes of the candidates."""
    return px.where("candidate").groupBy("final_code").agg(F.count("*").alias("n"))


def code_by_scene(px: DataFrame, code: int = 15) -> DataFrame:
    """Per region and scene time: pixels given a base code, how many of them the reference burns, and the share that it doesn't."""
    own = px.where(base_code(F.col("final_code")) == code).groupBy("region", "scene_epoch")
    table = own.agg(F.count("*").alias("n"), *count_columns(is_fire(F.col("ref_code")), F.lit(True))[:2])
    return table.withColumn("fp_rate", ratio(F.col("fp"), F.col("n")))


def margins(px: DataFrame) -> DataFrame:
    """Observed value minus threshold; >= 0 passes the test."""
    c = F.col
    diff = c("bt7") - c("bt14e")
    return px.withColumns({
        "mg_absdiff_vs_2K": F.abs(diff) - 2.0, "mg_d714_vs_std_7b14b": diff - c("std_7b14b"),
        "mg_d7bkg_vs_std_7b": c("bt7") - c("bt7_bkg") - c("std_7b"), "mg_refl_vs_std_reflb": c("refl") - c("std_reflb"),
        "mg_refl_vs_std_reflb_max": c("refl") - c("std_reflb_max"),
        "mg_reflmreflb_vs_std_reflb_max": c("refl") - c("reflb") - c("std_reflb_max"),
        "mg_bt14_vs_bkg14_minus20": c("bt14e") - c("bt14_bkg") + 20.0,
    })


def verdict(ref: Column, pred: Column) -> Column:
    return F.when(ref & pred, "TP").when(ref, "FN").when(pred, "FP").otherwise("TN")


def pixel_audit(px: DataFrame, everything: bool = False) -> DataFrame:
    """One row per pixel of interest with verdict, derived differences and margins."""
    ref, pred = is_fire(F.col("ref_code")), is_fire(F.col("final_code"))
    eco = F.col("eco_code").isin(150, 151, 152, 153)
    px = px.where("in_roi") if everything else px.where(F.col("in_roi") & (ref | pred | F.col("candidate") | eco))
    c = F.col
    return margins(px).withColumns({
        "ref_fire": ref.cast("int"), "pred_fire": pred.cast("int"), "verdict": verdict(ref, pred),
        "ref_base_code": base_code(c("ref_code")), "pred_base_code": base_code(c("final_code")),
        "stage_killed_by": gate_name(c("stage")), "diff_bt7_bt14": c("bt7") - c("bt14e"),
        "bt7_minus_bkg7": c("bt7") - c("bt7_bkg"), "bt14_minus_bkg14": c("bt14e") - c("bt14_bkg"),
        "refl_minus_reflb": c("refl") - c("reflb"), "t7_std_gap_stat_minus_hist": c("t7_stat_std") - c("t7_hist_std"),
    })


def missed_margins(audit: DataFrame) -> DataFrame:
    """Median of each margin over the missed fires of a stage."""
    missed = audit.where("verdict = 'FN'")
    table = missed.groupBy("stage", "stage_killed_by").agg(F.count("*").alias("n"))
    return table.join(medians(missed, ["stage"], MARGINS), "stage", "left")


def category_tally(px: DataFrame) -> DataFrame:
    fires = px.where("confirmed").withColumn("base_code", base_code(F.col("final_code")))
    table = fires.groupBy("base_code").agg(
        F.count("*").alias("n"), F.count_if(F.col("final_code") >= 30).alias("n_filtered"),
        F.max(F.when(F.col("final_frp") > 0, F.col("final_frp"))).alias("max_frp"),
    )
    positive = fires.where("final_frp > 0")
    return table.join(percentiles(positive, ["base_code"], "final_frp", {"median_frp": 0.5}), "base_code", "left")


def quality_flags(px: DataFrame) -> DataFrame:
    """Flag per pixel from the mask code; the code table is fixed, so it is broadcast."""
    spark = px.sparkSession
    table = spark.createDataFrame([(c, name, q) for c, name, q in k.MASK_CODES], "final_code int, meaning string, qa int")
    return px.join(F.broadcast(table), "final_code", "left")


def recall_by_code(px: DataFrame) -> DataFrame:
    """Part I recall per reference fire code; every code has a row."""
    one = px.groupBy().agg(*[F.count_if(F.col("ref_code") == c).alias(f"n_{c}") for c in k.FIRE_CODES],
                           *[F.count_if((F.col("ref_code") == c) & F.col("candidate")).alias(f"h_{c}") for c in k.FIRE_CODES])
    rows = F.array(*[F.struct(F.lit(c).alias("ref_code"), F.col(f"n_{c}").alias("n_ref"), F.col(f"h_{c}").alias("n_found")) for c in k.FIRE_CODES])
    return one.select(F.inline(rows)).withColumn("recall", F.coalesce(ratio(F.col("n_found"), F.col("n_ref")), F.lit(0.0)))


def sample_scenes(px: DataFrame, n: int, seed: int = 42, only_with_fire: bool = False) -> DataFrame:
    """A reproducible sample of n scenes, in scene order; n rows reach the end of the plan."""
    scenes = px.groupBy("scene").agg(F.count_if(is_fire(F.col("ref_code"))).alias("n_fire"))
    if only_with_fire:
        scenes = scenes.where("n_fire > 0")
    return scenes.orderBy(hash_order(F.col("scene"), seed=seed)).limit(n)


def discover(inventory: DataFrame, required: DataFrame) -> DataFrame:
    """Scenes for which every required product is present (relational division)."""
    needed = required.select("product").distinct()
    total = needed.agg(F.count("*").alias("_k"))
    have = inventory.select("scene", "product").distinct().join(needed, "product").groupBy("scene").agg(F.count("*").alias("_n"))
    return have.join(total, F.col("_n") == F.col("_k")).select("scene")


def compare_runs(a: DataFrame, b: DataFrame, di: int = 0, dj: int = 0) -> DataFrame:
    """Two masks of the same scenes, the second shifted by a grid offset: differing pixels and both sets of scores."""
    b = b.select(*SCENE, (F.col("i") - di).alias("i"), (F.col("j") - dj).alias("j"), F.col("final_code").alias("other_code"))
    both = a.join(b, ["region", "scene", "i", "j"])
    ref = is_fire(F.col("ref_code"))
    table = both.groupBy(*SCENE).agg(
        F.count("*").alias("n"), F.count_if(F.col("final_code") != F.col("other_code")).alias("n_differ"),
        *[c.alias(f"a_{n}") for n, c in zip(COUNTS, count_columns(ref, is_fire(F.col("final_code"))))],
        *[c.alias(f"b_{n}") for n, c in zip(COUNTS, count_columns(ref, is_fire(F.col("other_code"))))],
    )
    return table.withColumn("percent_differ", ratio(F.col("n_differ") * 100, F.col("n")))


def agreement(px: DataFrame) -> DataFrame:
    """Share of pixels where part I equals the reference, over reference codes that part I itself can give."""
    own = px.where(~is_fire(F.col("ref_code")))
    return own.groupBy(*SCENE).agg(F.count("*").alias("n"), F.avg((F.col("p1_code") == F.col("ref_code")).cast("double")).alias("accuracy"))


def tolerant_recall(px: DataFrame, radii: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """Recall when a candidate within r pixels counts: candidates are spread to their neighbourhood once, by distance.

    A fire then needs only the smallest distance found at its own pixel, one equi-join for all radii.
    """
    top = max(radii)
    steps = lambda: F.sequence(F.lit(-top), F.lit(top))
    near = px.where("candidate").select("region", "scene", "i", "j", F.explode(steps()).alias("_di")).select("*", F.explode(steps()).alias("_dj"))
    near = near.select(
        *SCENE, (F.col("i") + F.col("_di")).alias("i"), (F.col("j") + F.col("_dj")).alias("j"),
        F.greatest(F.abs("_di"), F.abs("_dj")).alias("_d"),
    ).groupBy("region", "scene", "i", "j").agg(F.min("_d").alias("distance"))
    fires = px.where(is_fire(F.col("ref_code"))).select("region", "scene", "i", "j").join(near, ["region", "scene", "i", "j"], "left")
    one = fires.agg(F.count("*").alias("n_fire"), *[F.count_if(F.col("distance") <= r).alias(f"r_{r}") for r in radii])
    rows = F.array(*[F.struct(F.lit(r).alias("radius"), F.col(f"r_{r}").alias("n_found")) for r in radii])
    return one.select("n_fire", F.inline(rows)).withColumn("recall", F.coalesce(ratio(F.col("n_found"), F.col("n_fire")), F.lit(0.0)))


def missed_by_category(px: DataFrame) -> DataFrame:
    missed = px.where(is_fire(F.col("ref_code")) & ~F.col("candidate"))
    return missed.groupBy(base_code(F.col("ref_code")).alias("category"), "p1_code").agg(F.count("*").alias("n"))


def local_contrast(px: DataFrame, targets: DataFrame, value: str, radius: int = 2) -> DataFrame:
    """Median of the neighbourhood without the centre and the contrast to it, for target pixels only.

    A target becomes 24 keys that meet at most one pixel each; the median sees at most 24 values.
    """
    span = [d for d in range(-radius, radius + 1)]
    steps = F.array(*[F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj")) for a in span for b in span if a or b])
    asked = targets.select(*SCENE, F.col("i").alias("ci"), F.col("j").alias("cj"), F.inline(steps))
    asked = asked.select(*SCENE, "ci", "cj", (F.col("ci") + F.col("di")).alias("i"), (F.col("cj") + F.col("dj")).alias("j"))
    around = asked.join(px.select("region", "scene", "i", "j", F.col(value).alias("_v")), ["region", "scene", "i", "j"])
    medians = around.groupBy(*SCENE, F.col("ci").alias("i"), F.col("cj").alias("j")).agg(
        F.median("_v").alias("local_median"), F.count("_v").alias("n_neighbours")
    )
    return targets.join(medians, ["region", "scene", "i", "j"], "left").withColumn("contrast", F.col(value) - F.col("local_median"))


def group_statistics(px: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    base = px.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"))
    return base.join(percentiles(px, by, value, {"q25": 0.25, "median": 0.5, "q75": 0.75}), list(by), "left")


def threshold_sweep(px: DataFrame, value: str, positive: Column, thresholds: Sequence[float]) -> DataFrame:
    """Kept true and false positives for each threshold: rows are counted by the highest threshold they reach."""
    reached = F.lit(0)
    for t in thresholds:
        reached = reached + holds(F.col(value) >= t).cast("int")
    counts = px.groupBy(reached.alias("_step")).agg(F.count_if(positive).alias("_tp"), F.count_if(~positive).alias("_fp"))
    one = counts.agg(*[F.sum(F.when(F.col("_step") > n, F.col(c))).alias(f"{c}{n}") for n in range(len(thresholds)) for c in ("_tp", "_fp")])
    rows = F.array(*[
        F.struct(F.lit(float(t)).alias("threshold"), F.coalesce(F.col(f"_tp{n}"), F.lit(0)).alias("tp"), F.coalesce(F.col(f"_fp{n}"), F.lit(0)).alias("fp"))
        for n, t in enumerate(thresholds)
    ])
    return one.select(F.inline(rows)).withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp")))


def binned_rate(px: DataFrame, value: str, flagged: Column, bins: int = 20) -> DataFrame:
    """Equal-width bins between the smallest and largest value, with the share of flagged rows in each."""
    bounds = px.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))  # one row
    placed = px.where(F.col(value).isNotNull()).join(F.broadcast(bounds))
    at = F.floor((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins)
    table = placed.groupBy(F.least(at, F.lit(bins - 1)).cast("int").alias("bin")).agg(
        F.count("*").alias("n"), F.count_if(flagged).alias("n_flagged")
    )
    return table.withColumn("rate", ratio(F.col("n_flagged"), F.col("n")))


def map_points(px: DataFrame) -> DataFrame:
    """Ecosystem issues, misses and false alarms inside the region, as points with a kind."""
    ref, pred = is_fire(F.col("ref_code")), is_fire(F.col("final_code"))
    kinds = F.array_compact(F.array(
        F.when(F.col("eco_code").isin(150, 151, 152, 153), "eco"), F.when(ref & ~pred, "FN"), F.when(~ref & pred, "FP"),
    ))
    return px.where("in_roi").select("region", "scene", "i", "j", "lat", "lon", F.explode(kinds).alias("kind"))


def correction_chain(px: DataFrame, stages: Sequence[str]) -> DataFrame:
    """Each stage's temperature as a row, and the first stage whose temperature is missing or not positive."""
    rows = F.array(*[F.struct(F.lit(n).alias("ord"), F.lit(s).alias("step"), F.col(s).cast("double").alias("value")) for n, s in enumerate(stages)])
    return px.select("region", "scene", "i", "j", F.inline(rows))


def first_failure(chain: DataFrame) -> DataFrame:
    bad = chain.where(~holds(F.col("value") > 0))
    return bad.groupBy("region", "scene", "i", "j").agg(F.min_by("step", "ord").alias("failed_step"))


def corrected_temperatures(px: DataFrame) -> DataFrame:
    """Band 7 temperature after each correction: as measured, vapour, emissivity, solar, diffraction."""
    seven = BandCoefficients.of(7)
    return px.withColumns({f"t7_{step}": temperature_of(F.col(f"r7_{step}"), seven) for step in ("em", "solar", "diff")})


CHAIN = ("bt7", "t7_tpw", "t7_em", "t7_solar", "t7_diff")


def failures_by_category(px: DataFrame, stages: Sequence[str] = CHAIN) -> DataFrame:
    """Reference categories by the first step of the chain that failed; `none` where all steps hold."""
    bad = first_failure(correction_chain(px, stages))
    named = px.select(*SCENE, "i", "j", base_code(F.col("ref_code")).alias("category"))
    return named.join(bad, [*SCENE, "i", "j"], "left").groupBy("category", F.coalesce("failed_step", F.lit("none")).alias("failed_step")).agg(F.count("*").alias("n"))


def source_check(px: DataFrame, value: str, constant: float) -> DataFrame:
    return px.groupBy(*SCENE).agg(
        F.min(value).alias("low"), F.max(value).alias("high"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"),
        F.avg((F.col(value) == constant).cast("double")).alias("share_constant"),
    )


def window_attempts(counts: DataFrame, halves: Sequence[int] = k.HALF_WIDTHS) -> DataFrame:
    """Each window a pixel tried, up to the first that was valid enough."""
    rows = F.array(*[
        F.struct(F.lit(n).alias("n_iter"), F.lit(h).alias("half"), F.lit((2 * h + 1) ** 2).alias("window_size"), F.col(f"n_{h}").alias("n_valid"))
        for n, h in enumerate(halves)
    ])
    tried = counts.select("region", "scene", "i", "j", "half_width", F.inline(rows)).where(F.col("half") <= F.coalesce("half_width", F.lit(halves[-1])))
    return tried.withColumn("enough", F.col("n_valid") >= k.VALID_FRACTION * F.col("window_size"))
