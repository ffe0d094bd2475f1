"""Checks of the audit tables and the scenario analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberframe import codes as k
from emberframe.checks.common import Book, gated, px_sql, rd, rds, srd, srds, trace
from emberframe.checks.oracle import tmp, upto
from emberframe.operators import audit, background, clusters, scenario
from emberframe.plans import variants
from emberframe.sources import views

BOOK = Book.empty()
add = BOOK.add
FIRES = "(" + ", ".join(str(c) for c in k.FIRE_CODES) + ")"
REF, PRED = f"ref_code in {FIRES}", f"final_code in {FIRES}"
ALL_CODES = [c for c, _, _ in k.MASK_CODES]
BASE = lambda c: f"(case when {c} between 30 and 35 then {c} - 20 else {c} end)"


def ref(name="ref_code"):
    return audit.is_fire(F.col(name))


def _score_sql(ref_sql: str, pred_sql: str) -> str:
    return (f"count(*) filter (where ({ref_sql}) and ({pred_sql})) tp, count(*) filter (where not ({ref_sql}) and ({pred_sql})) fp, "
            f"count(*) filter (where ({ref_sql}) and not ({pred_sql})) fn, count(*) filter (where not ({ref_sql}) and not ({pred_sql})) tn")


_FINISH = (
    f"tp, fp, fn, tn, tp + fn support_ref, tp + fp support_pred, {srd('case when tp + fp = 0 then 0 else tp / (tp + fp) end')} as precision, "
    f"{srd('case when tp + fn = 0 then 0 else tp / (tp + fn) end')} as recall, "
    f"{srd('case when tp = 0 then 0 else 2 * tp / (2 * tp + fp + fn) end')} f1"
)
_SCORE_COLUMNS = ["tp", "fp", "fn", "tn", "support_ref", "support_pred"]


def scored(df, *names):
    return df.select(*names, *_SCORE_COLUMNS, *rds("precision recall f1"))


@add("e1_binary_scores", upto("mask", f"select {_FINISH} from (select {_score_sql(REF, PRED)} from mask)"))
def _(spark, sf):
    return scored(audit.binary_scores(trace(spark, sf), ref(), ref("final_code")))


@add("e2_base_codes", upto("mask", f"select {BASE('ref_code')} ref_base, {BASE('final_code')} pred_base, count(*) n from mask group by all"))
def _(spark, sf):
    px = trace(spark, sf)
    return px.groupBy(audit.base_code(F.col("ref_code")).alias("ref_base"), audit.base_code(F.col("final_code")).alias("pred_base")).agg(F.count("*").alias("n"))


def _one_vs_rest_sql(kind: str, codes, ref_sql: str, pred_sql: str) -> str:
    return f"""select '{kind}' kind, fc as code, {_FINISH} from (select fc, {_score_sql(f'{ref_sql} = fc', f'{pred_sql} = fc')} from mask,
      (select unnest([{", ".join(map(str, codes))}]) fc) where in_roi group by fc)"""


@add("e3_one_vs_rest", upto("mask", _one_vs_rest_sql("code", k.FIRE_CODES, "ref_code", "final_code") + " union all "
                            + _one_vs_rest_sql("base", k.BASE_FIRE_CODES, BASE("ref_code"), BASE("final_code"))))
def _(spark, sf):
    px = trace(spark, sf)
    ref_code, final_code = F.col("ref_code"), F.col("final_code")
    single = audit.one_vs_rest(px, ref_code, final_code, k.FIRE_CODES).withColumn("kind", F.lit("code"))
    base = audit.one_vs_rest(px, audit.base_code(ref_code), audit.base_code(final_code), k.BASE_FIRE_CODES).withColumn("kind", F.lit("base"))
    return scored(single.unionByName(base), "kind", "code")


@add("e4_recall_by_code", upto("mask", f"""
    select fc ref_code, count(ref_code) n_ref, count(*) filter (where candidate) n_found,
      {srd('coalesce(count(*) filter (where candidate) / nullif(count(ref_code), 0), 0)')} recall
    from (select unnest([{", ".join(map(str, k.FIRE_CODES))}]) fc) left join mask on ref_code = fc group by fc"""))
def _(spark, sf):
    return audit.recall_by_code(trace(spark, sf)).select("ref_code", "n_ref", "n_found", *rds("recall"))


_LOW = f"({BASE('ref_code')} = 15 or {BASE('final_code')} = 15)"


@add("e5_scene_metrics", upto("mask", " union all ".join(
    f"select region, scene, is_total, '{name}' variant, {_FINISH} from (select region, scene, grouping(scene) is_total, {_score_sql(REF, pred)} from mask where in_roi {extra} group by grouping sets ((region, scene), ()))"
    for name, pred, extra in (("part1", "candidate", ""), ("part2", PRED, ""), ("part1_no_low", "candidate", f"and not {_LOW}"), ("part2_no_low", PRED, f"and not {_LOW}"))
)))
def _(spark, sf):
    return scored(audit.scene_metrics(trace(spark, sf)), "region", "scene", F.col("is_total").cast("long").alias("is_total"), "variant")


@add("e6_confusion", upto("mask", f"select ref_code, final_code, count(*) n from mask where in_roi and ({REF} or {PRED}) group by all"))
def _(spark, sf):
    return audit.confusion(trace(spark, sf))


@add("e6_confusion_matrix", upto("mask", f"""
    select ref_code, {", ".join(f'count(*) filter (where final_code = {c}) "{c}"' for c in ALL_CODES)} from mask where in_roi and ({REF} or {PRED}) group by ref_code"""))
def _(spark, sf):
    return audit.confusion_matrix(trace(spark, sf), ALL_CODES)


@add("e7_recall_funnel", upto("mask", f"""
    select p1_stage stage, p1_code, fail_char, count(*) n from mask where in_roi and {REF} group by grouping sets ((p1_stage), (p1_stage, p1_code), (p1_stage, fail_char))"""))
def _(spark, sf):
    return audit.recall_funnel(trace(spark, sf)).select("stage", "p1_code", "fail_char", "n")


@add("e7_stage_counts", upto("mask", "select p1_stage stage, count(*) n from mask group by 1"))
def _(spark, sf):
    return audit.stage_counts(trace(spark, sf))


@add("e8_false_positives", upto("mask", f"""
    select final_code, ref_code, flag_out flag, count(*) n from mask where {PRED} and not {REF} group by grouping sets ((final_code), (ref_code), (flag_out))"""))
def _(spark, sf):
    return audit.false_positives(trace(spark, sf))


@add("e9_background_summary", upto("mask", f"""
    select population, count(*) n, count(*) filter (where approach = 'stat') n_stat, count(*) filter (where approach = 'hist') n_hist,
      {srd('median(t7_stat_std)')} median_t7_stat_std, {srd('median(t7_hist_std)')} median_t7_hist_std, {srd('median(n_hist)')} median_n_hist
    from (select *, unnest(case when candidate then ['candidates', 'with_background'] else ['with_background'] end) population from mask where half_width is not null)
    group by population"""))
def _(spark, sf):
    table = audit.background_summary(trace(spark, sf))
    return table.select("population", "n", "n_stat", "n_hist", *rds("median_t7_stat_std median_t7_hist_std median_n_hist"))


@add("e9_half_widths", upto("mask", "select half_width, count(*) with_background, count(*) filter (where candidate) candidates from mask where half_width is not null group by 1"))
def _(spark, sf):
    return audit.half_width_counts(trace(spark, sf))


@add("e10_part_two_paths", upto("mask", """
    select count(*) n_candidates, count(elim_reason) n_eliminated, count(*) filter (where confirmed) n_confirmed, 0 policy_rejected,
      count(*) filter (where elim_reason = 'cond1') cond1, count(*) filter (where elim_reason = 'cond2') cond2, count(*) filter (where elim_reason = 'cond3') cond3,
      count(*) filter (where elim_reason is null and flag0 <> fail_char) glint_edge, count(*) filter (where elim_reason is null and flag1 <> flag0) fog_edge,
      count(*) filter (where elim_reason is null and upgraded = 13) upgraded_13, count(*) filter (where elim_reason is null and upgraded = 14) upgraded_14,
      count(*) filter (where elim_reason is null and upgraded = 15) upgraded_15, count(*) filter (where temporally_filtered) temporally_filtered
    from mask where candidate"""))
def _(spark, sf):
    return audit.part_two_paths(trace(spark, sf))


@add("e10_final_codes", upto("mask", "select final_code, count(*) n from mask where candidate group by 1"))
def _(spark, sf):
    return audit.final_codes(trace(spark, sf))


_MG = {
    "mg_absdiff_vs_2K": "abs(bt7 - bt14e) - 2", "mg_d714_vs_std_7b14b": "bt7 - bt14e - std_7b14b", "mg_d7bkg_vs_std_7b": "bt7 - bt7_bkg - std_7b",
    "mg_refl_vs_std_reflb": "refl - std_reflb", "mg_refl_vs_std_reflb_max": "refl - std_reflb_max",
    "mg_reflmreflb_vs_std_reflb_max": "refl - reflb - std_reflb_max", "mg_bt14_vs_bkg14_minus20": "bt14e - bt14_bkg + 20",
}
_VERDICT = f"case when {REF} and {PRED} then 'TP' when {REF} then 'FN' when {PRED} then 'FP' else 'TN' end"


@add("e11_pixel_audit", upto("mask", f"""
    select region, scene, i, j, {_VERDICT} verdict, p1_stage stage, p1_code, final_code, ref_code, {BASE('final_code')} pred_base_code, approach, elim_reason,
      {srd('bt7 - bt7_bkg', 2)} bt7_minus_bkg7, {", ".join(f"{srd(v, 2)} {n}" for n, v in _MG.items())}
    from mask where in_roi and ({REF} or {PRED} or candidate or eco_code in (150, 151, 152, 153))"""))
def _(spark, sf):
    rows = audit.pixel_audit(trace(spark, sf))
    return rows.select("region", "scene", "i", "j", "verdict", "stage", "p1_code", "final_code", "ref_code", "pred_base_code", "approach", "elim_reason",
                       *rds("bt7_minus_bkg7", 2), *rds(" ".join(_MG), 2))


@add("e12_micro_scores", upto("mask", f"""
    select region, scene, {_FINISH}, is_total from (select region, scene, {_score_sql(REF, PRED)}, grouping(scene) is_total from mask where in_roi group by grouping sets ((region, scene), ()))"""))
def _(spark, sf):
    return scored(audit.rollup_scores(trace(spark, sf), ref(), ref("final_code")), "region", "scene", F.col("is_total").cast("long").alias("is_total"))


@add("e13_missed_margins", upto("mask", f"""
    select p1_stage stage, count(*) n, {", ".join(f"{srd(f'median({v})', 3)} {n}" for n, v in _MG.items())}
    from mask where in_roi and {REF} and not {PRED} group by 1"""))
def _(spark, sf):
    return audit.missed_margins(audit.pixel_audit(trace(spark, sf))).select("stage", "n", *rds(" ".join(_MG), 3))


@add("e14_scene_sample", px_sql(f"""
    select scene, count(*) filter (where {REF}) n_fire from px group by scene having count(*) filter (where {REF}) > 0 order by md5(concat_ws('|', '42', scene::varchar)) limit 3"""))
def _(spark, sf):
    return audit.sample_scenes(views.pixels(spark, sf), 3, 42, only_with_fire=True)


@add("e15_scene_discovery", """
    with inv as (select distinct event_type product, user_id * 10 + floor(epoch(ts))::bigint // 604800 % 10 scene from events)
    select scene from inv group by scene having count(*) = (select count(distinct event_type) from events)""")
def _(spark, sf):
    """A user's events of a week as the inventory of a scene: a product is absent where there is no event of its type."""
    ev = views.events(spark, sf).select(F.col("event_type").alias("product"), F.expr("user_id * 10 + unix_timestamp(ts) div 604800 % 10").alias("scene"))
    return audit.discover(ev, ev.select("product"))


@add("e17_padded_comparison", upto("mask", f"""
    select a.region, a.scene, count(*) n, count(*) filter (where a.final_code <> b.final_code) n_differ,
      {", ".join(f"count(*) filter (where {'' if r else 'not '}(a.ref_code in {FIRES}) and {'' if p else 'not '}({s}.final_code in {FIRES})) {s}_{n}" for s in 'ab' for n, r, p in (('tp', 1, 1), ('fp', 0, 1), ('fn', 1, 0), ('tn', 0, 0)))},
      {srd('100 * count(*) filter (where a.final_code <> b.final_code) / count(*)')} percent_differ
    from mask a join mask b on a.region = b.region and a.scene = b.scene and a.i = b.i - 2 and a.j = b.j - 3 group by a.region, a.scene"""))
def _(spark, sf):
    px = trace(spark, sf)
    table = audit.compare_runs(px, px.select("region", "scene", "i", "j", "final_code"), 2, 3)
    return table.select(*[c for c in table.columns if c != "percent_differ"], *rds("percent_differ"))


@add("e18_agreement", upto("mask", f"select region, scene, count(*) n, {srd('avg((p1_code = ref_code)::int)')} accuracy from mask where not {REF} group by region, scene"))
def _(spark, sf):
    return audit.agreement(trace(spark, sf)).select("region", "scene", "n", *rds("accuracy"))


@add("e19_tolerant_recall", upto("mask", f"""
    select radius, n_fire, n_found, {srd('n_found / n_fire')} recall from (select radius, count(*) n_fire, count(*) filter (where exists (select 1 from mask c
      where c.candidate and c.region = f.region and c.scene = f.scene and abs(c.i - f.i) <= radius and abs(c.j - f.j) <= radius)) n_found
    from mask f, (select unnest([1, 2, 3]) radius) where f.ref_code in {FIRES} group by radius)"""))
def _(spark, sf):
    return audit.tolerant_recall(trace(spark, sf)).select("radius", "n_fire", "n_found", *rds("recall"))


@add("e20_missed_by_category", upto("mask", f"select {BASE('ref_code')} category, p1_code, count(*) n from mask where {REF} and not candidate group by all"))
def _(spark, sf):
    return audit.missed_by_category(trace(spark, sf))


@add("e21_code_histogram", upto("mask", "select final_code, count(*) n from mask group by 1"))
def _(spark, sf):
    return trace(spark, sf).groupBy("final_code").agg(F.count("*").alias("n"))


@add("e22_local_contrast", upto("mask", f"""
    select a.region, a.scene, a.i, a.j, count(b.bt7) n_neighbours, {srd('median(b.bt7)', 3)} local_median, {srd('any_value(a.bt7) - median(b.bt7)', 3)} contrast
    from mask a join mask b on a.region = b.region and a.scene = b.scene and abs(a.i - b.i) <= 2 and abs(a.j - b.j) <= 2 and (a.i <> b.i or a.j <> b.j)
    where a.final_code in {FIRES} group by all"""))
def _(spark, sf):
    px = trace(spark, sf).select("region", "scene", "i", "j", "bt7", "final_code")
    rows = audit.local_contrast(px, px.where(audit.is_fire(F.col("final_code"))), "bt7")
    return rows.select("region", "scene", "i", "j", "n_neighbours", *rds("local_median contrast", 3))


_STATS = f"count(v) n, {srd('avg(v)', 3)} mean, {srd('min(v)', 3)} low, {srd('max(v)', 3)} high, {srd('quantile_cont(v, 0.25)', 3)} q25, {srd('median(v)', 3)} median, {srd('quantile_cont(v, 0.75)', 3)} q75"


@add("e23_category_statistics", upto("mask", f"select {_VERDICT} verdict, final_code, {_STATS} from (select *, bt7 - bt7_bkg v from mask) where {PRED} or {REF} group by 1, 2"))
def _(spark, sf):
    px = trace(spark, sf).where(ref() | ref("final_code")).withColumns({
        "verdict": audit.verdict(ref(), ref("final_code")), "v": F.col("bt7") - F.col("bt7_bkg"),
    })
    return audit.group_statistics(px, ["verdict", "final_code"], "v").select("verdict", "final_code", "n", *rds("mean low high q25 median q75", 3))


@add("e23_code_15_by_scene", upto("mask", f"""
    select region, scene_epoch, count(*) n, count(*) filter (where {REF}) tp, count(*) filter (where not {REF}) fp, {srd(f'count(*) filter (where not {REF}) / count(*)')} fp_rate
    from mask where {BASE('final_code')} = 15 group by region, scene_epoch"""))
def _(spark, sf):
    return audit.code_by_scene(trace(spark, sf)).select("region", "scene_epoch", "n", "tp", "fp", *rds("fp_rate"))


@add("e23_hourly_statistics", upto("mask", f"select scene_epoch // 3600 % 24 as hour, {_STATS} from (select *, bt7 - bt14e v from mask) where {PRED} group by 1"))
def _(spark, sf):
    px = trace(spark, sf).where(ref("final_code")).withColumns({
        "hour": F.hour(F.timestamp_seconds("scene_epoch")).cast("long"), "v": F.col("bt7") - F.col("bt14e"),
    })
    return audit.group_statistics(px, ["hour"], "v").select("hour", "n", *rds("mean low high q25 median q75", 3))


_THRESHOLDS = (0.0, 2.0, 4.0, 6.0, 8.0, 10.0, 15.0)


@add("e23_contrast_sweep", upto("mask", f"""
    select t threshold, count(*) filter (where {REF} and bt7 - bt7_bkg >= t) tp, count(*) filter (where not {REF} and bt7 - bt7_bkg >= t) fp,
      {srd(f'count(*) filter (where {REF} and bt7 - bt7_bkg >= t) / nullif(count(*) filter (where bt7 - bt7_bkg >= t), 0)')} as precision
    from mask, (select unnest([{", ".join(map(str, _THRESHOLDS))}])::double t) where candidate group by t"""))
def _(spark, sf):
    px = trace(spark, sf).where("candidate").withColumn("v", F.col("bt7") - F.col("bt7_bkg"))
    return audit.threshold_sweep(px, "v", ref(), _THRESHOLDS).select("threshold", "tp", "fp", *rds("precision"))


@add("e24_difference_bins", px_sql(f"""
    , d as (select bt7 - bt14 v, {REF} f from px where bt7 is not null and bt14 is not null)
    select cast(least(floor((v - lo) / (hi - lo) * 20), 19) as int) bin, count(*) n, count(*) filter (where f) n_flagged, {srd('count(*) filter (where f) / count(*)')} rate
    from d, (select min(v) lo, max(v) hi from d) group by 1"""))
def _(spark, sf):
    px = views.pixels(spark, sf).withColumn("v", F.col("bt7") - F.col("bt14"))
    return audit.binned_rate(px, "v", ref()).select("bin", "n", "n_flagged", *rds("rate"))


@add("e25_map_points", upto("mask", f"""
    select region, scene, i, j, {srds('lat lon')}, unnest(list_filter([case when eco_code in (150, 151, 152, 153) then 'eco' end, case when {REF} and not {PRED} then 'FN' end,
      case when not {REF} and {PRED} then 'FP' end], lambda x: x is not null)) kind from mask where in_roi"""))
def _(spark, sf):
    return audit.map_points(trace(spark, sf)).select("region", "scene", "i", "j", "kind", *rds("lat lon"))


_CHAIN = dict(zip(audit.CHAIN, ("c.bt7", "c.t7_tpw", tmp("7", "c.r7_em"), tmp("7", "c.r7_solar"), tmp("7", "c.r7_diff"))))


@add("e26_correction_chain", upto("mask", f"""
    select c.region, c.scene, c.i, c.j, u.ord, u.step, {srd('u.value', 3)} as value from cor c,
      lateral (select unnest([0, 1, 2, 3, 4]) ord, unnest([{", ".join(f"'{s}'" for s in _CHAIN)}]) step, unnest([{", ".join(_CHAIN.values())}]) as value) u"""))
def _(spark, sf):
    rows = audit.corrected_temperatures(trace(spark, sf).where("r7_tpw is not null"))
    return audit.correction_chain(rows, audit.CHAIN).select("region", "scene", "i", "j", "ord", "step", *rds("value", 3))


_FAILED = "case " + " ".join(f"when ({sql} > 0) is not true then '{name}'" for name, sql in _CHAIN.items()) + " end"


@add("e26_first_failure", upto("mask", f"""
    select region, scene, i, j, failed_step from (select c.region, c.scene, c.i, c.j, {_FAILED} failed_step from cor c) where failed_step is not null"""))
def _(spark, sf):
    rows = audit.corrected_temperatures(trace(spark, sf).where("r7_tpw is not null"))
    return audit.first_failure(audit.correction_chain(rows, audit.CHAIN))


@add("e26_failures_by_category", upto("mask", f"""
    select {BASE('c.ref_code')} category, coalesce({_FAILED}, 'none') failed_step, count(*) n from cor c group by 1, 2"""))
def _(spark, sf):
    return audit.failures_by_category(audit.corrected_temperatures(trace(spark, sf).where("r7_tpw is not null")))


@add("e27_emissivity_source", px_sql(f"""
    select region, scene, {srd('min(emiss7)')} low, {srd('max(emiss7)')} high, {srd('avg(emiss7)')} mean, {srd('stddev_pop(emiss7)')} std, {srd('avg((emiss7 = 95e-2)::int)')} share_constant
    from px group by region, scene"""))
def _(spark, sf):
    return audit.source_check(views.pixels(spark, sf), "emiss7", 0.95).select("region", "scene", *rds("low high mean std share_constant"))


@add("e28_window_attempts", upto("levels", " union all ".join(
    f"select region, scene, i, j, {n} n_iter, {h} half, {(2 * h + 1) ** 2} window_size, n_{h} n_valid, n_{h} >= 2e-1 * {(2 * h + 1) ** 2} enough from levels where {h} <= coalesce(half_width, 55)"
    for n, h in enumerate(k.HALF_WIDTHS)
)))
def _(spark, sf):
    counts = background.valid_counts(gated(spark, sf)).where("survivor")
    return audit.window_attempts(counts).select("region", "scene", "i", "j", "n_iter", "half", "window_size", "n_valid", "enough")


_FIRE_PIX = px_sql(f""", f as (select region, scene, i, j, i * 50 + j id from px where {REF}),
    e as (select a.region, a.scene, a.id a, b.id b from f a join f b on a.region = b.region and a.scene = b.scene and abs(a.i - b.i) <= 1 and abs(a.j - b.j) <= 1),
    walk as (select region, scene, id, id label from f union select w.region, w.scene, e.b, w.label from walk w join e on e.region = w.region and e.scene = w.scene and e.a = w.id)
    select region, scene, label, count(*) n, {srd('avg(id // 50)')} ci, {srd('avg(id % 50)')} cj from (select region, scene, id, cast(min(label) as bigint) label from walk group by all) group by all""").replace("with px", "with recursive px")


@add("e29_fire_clusters", _FIRE_PIX)
def _(spark, sf):
    fires = views.pixels(spark, sf).where(ref())
    return clusters.centroids(clusters.fire_clusters(fires, 50)).select("region", "scene", "label", "n", *rds("ci cj"))


def _components(name: str, where: str) -> str:
    """SQL of the clusters of a mask: pixels with the smallest pixel number reachable."""
    near = "a.region = b.region and a.scene = b.scene and abs(a.i - b.i) <= 1 and abs(a.j - b.j) <= 1"
    return f"""
    {name}_f as materialized (select region, scene, i, j, i * 50 + j id from mask where {where}),
    {name}_e as materialized (select a.region, a.scene, a.id a, b.id b from {name}_f a join {name}_f b on {near}),
    {name}_w as (select region, scene, id, id label from {name}_f union select w.region, w.scene, e.b, w.label from {name}_w w join {name}_e e on e.region = w.region and e.scene = w.scene and e.a = w.id),
    {name} as materialized (select region, scene, id, min(label) label from {name}_w group by all),
    {name}_c as materialized (select region, scene, label, count(*) n, avg(id // 50) ci, avg(id % 50) cj from {name} group by all)"""


def cluster_masks(spark, sf):
    px = trace(spark, sf)
    return [clusters.fire_clusters(px.where(c), 50, tile=16) for c in (ref(), F.col("final_code").isin(*k.FIRE_CODES))]


_MATCH = f"""
    , {_components('rc', REF)}, {_components('pc', f'final_code in {FIRES}')},
    shared as (select rc.region, rc.scene, rc.label ref, pc.label pred, count(*) n from rc join pc using (region, scene, id) group by all),
    best as (select region, scene, ref, arg_max(pred, (n, -pred)) pred, max(n) n from shared group by all),
    matched as (select r.region, r.scene, r.label, r.n, coalesce(b.n, 0) shared, case when b.n >= 5e-1 * r.n then b.pred end other,
        case when b.n >= 5e-1 * r.n then sqrt((r.ci - p.ci) * (r.ci - p.ci) + (r.cj - p.cj) * (r.cj - p.cj)) end distance
      from rc_c r left join best b on r.region = b.region and r.scene = b.scene and r.label = b.ref left join pc_c p on p.region = b.region and p.scene = b.scene and p.label = b.pred)"""


@add("e29_cluster_match", upto("mask", f"{_MATCH} select region, scene, label::bigint label, n, shared, other::bigint as other, {srd('distance')} distance from matched"))
def _(spark, sf):
    reference, predicted = cluster_masks(spark, sf)
    return clusters.match_clusters(reference, predicted, 0.5).select("region", "scene", "label", "n", "shared", "other", rd("distance").alias("distance"))


@add("e29_cluster_scores", upto("mask", f"""{_MATCH},
    hits as (select region, scene, count(*) n_ref, count(other) n_hit, avg(distance) distance from matched group by all),
    found as (select region, scene, count(*) n_pred, count(*) filter (where label not in (select pred from shared s where s.region = c.region and s.scene = c.scene)) n_false from pc_c c group by all)
    select coalesce(h.region, f.region) region, coalesce(h.scene, f.scene) scene, coalesce(n_ref, 0) n_ref, coalesce(n_hit, 0) n_hit, coalesce(n_pred, 0) n_pred, coalesce(n_false, 0) n_false,
      {srd('n_hit / n_ref')} hit_rate, {srd('distance')} distance from hits h full join found f on h.region = f.region and h.scene = f.scene"""))
def _(spark, sf):
    reference, predicted = cluster_masks(spark, sf)
    return clusters.cluster_scores(reference, predicted, 0.5).select("region", "scene", "n_ref", "n_hit", "n_pred", "n_false", *rds("hit_rate distance"))


# Scenario -------------------------------------------------------------------------------------------------------------
def variant_masks(spark, sf):
    """The detector over all variants at once; each is checked against its own run of the oracle."""
    from emberframe.checks.common import product

    return product(spark, sf, "variants", lambda: variants.variant_masks(views.scene_pixels(spark, sf), views.lut(spark)))


def _variant_px(name: str) -> str:
    changes = {
        "baseline": "", "tpw_climatology": "replace (40e0 as tpw)", "tpw_25": "replace (25e0 as tpw)", "tpw_minus_10": "replace (greatest(tpw - 10, 0e0) as tpw)",
        "tpw_plus_10": "replace (tpw + 10 as tpw)", "neutral_lut": "", "emissivity_one": "replace (1e0 as emiss7, 1e0 as emiss14)",
        "emissivity_constant": "replace (95e-2 as emiss7, 97e-2 as emiss14)", "no_band_2": "replace (null::double as refl2)",
        "no_band_15": "replace (null::double as bt15)", "forced_hybrid": "replace (91e0 as fpt)", "no_quality": "",
    }
    return changes[name]


def _variants_sql(body: str) -> str:
    """The oracle once per variant, each in its own scope."""
    parts = []
    for name in scenario.VARIANTS:
        sql = upto("mask", "select i, j, region, scene, ref_code, candidate, final_code from mask")
        head = "px as materialized ("
        start = sql.index(head) + len(head)
        end = sql.index(", bounds as")
        inner = sql[start:end - 1]
        sql = sql[:start] + f"select * {_variant_px(name)} from ({inner})" + sql[end - 1:]
        if name == "neutral_lut":
            sql = sql.replace("9e-1 - 3e-2 * (id // 7 + 1) - 1e-2 * (id % 7 + 1) trans_4um, 88e-2 - 3e-2 * (id // 7 + 1) - 1e-2 * (id % 7 + 1) trans_11um", "1e0 trans_4um, 1e0 trans_11um")
            sql = sql.replace("1e-3 * (id // 7 + 1) offset_4um, 1e-2 * (id // 7 + 1) offset_11um", "0e0 offset_4um, 0e0 offset_11um")
        parts.append(f"v_{name} as materialized (select '{name}' variant, region base_region, scene base_scene, * exclude (region, scene) from ({sql}))")
    union = " union all ".join(f"select * from v_{n}" for n in scenario.VARIANTS)
    return f"with {', '.join(parts)}, allv as materialized ({union}) {body}"


@add("a1_variants", _variants_sql("select variant, base_region, base_scene, count(*) n, count(*) filter (where candidate) n_candidates, sum(final_code)::bigint code_sum from allv group by all"))
def _(spark, sf):
    return variant_masks(spark, sf).groupBy("variant", "base_region", "base_scene").agg(
        F.count("*").alias("n"), F.count_if("candidate").alias("n_candidates"), F.sum("final_code").alias("code_sum")
    )


_CATEGORIES = ", ".join(f"count(*) filter (where {BASE('final_code')} = {c}) n_{c}" for c in k.BASE_FIRE_CODES)


@add("a2_variant_scores", _variants_sql(f"select variant, n_candidates, {', '.join(f'n_{c}' for c in k.BASE_FIRE_CODES)}, {_FINISH} from (select variant, count(*) filter (where candidate) n_candidates, {_CATEGORIES}, {_score_sql(REF, PRED)} from allv group by variant)"))
def _(spark, sf):
    return scored(scenario.variant_scores(variant_masks(spark, sf)), "variant", "n_candidates", *[f"n_{c}" for c in k.BASE_FIRE_CODES])


@add("a3_against_baseline", _variants_sql(f"""
    , p as (select *, {PRED} pred, {REF} ref from allv), b as (select base_region, base_scene, i, j, pred base from p where variant = 'baseline')
    select variant, count(*) filter (where pred <> base) changed, count(*) filter (where pred <> base and ref and base) tp_lost,
      count(*) filter (where pred <> base and ref and pred) tp_gained, count(*) filter (where pred <> base and not ref and base) fp_removed,
      count(*) filter (where pred <> base and not ref and pred) fp_added from p join b using (base_region, base_scene, i, j) where variant <> 'baseline' group by variant"""))
def _(spark, sf):
    return scenario.against_baseline(variant_masks(spark, sf))


@add("a4_variant_rollup", _variants_sql(f"""
    select variant, base_region, base_scene, is_total, tp, fp, fn, tn, {srd('case when tp + fp = 0 then 0 else tp / (tp + fp) end')} as precision from
    (select variant, base_region, base_scene, grouping(base_scene) is_total, {_score_sql(REF, PRED)} from allv group by grouping sets ((variant, base_region, base_scene), (variant)))"""))
def _(spark, sf):
    return scenario.variant_rollup(variant_masks(spark, sf)).select("variant", "base_region", "base_scene", F.col("is_total").cast("long").alias("is_total"), "tp", "fp", "fn", "tn", *rds("precision"))


@add("a5_ancillary_snapshot", px_sql(f"""
    select region, scene, {srd('min(tpw)')} tpw_min, {srd('max(tpw)')} tpw_max, {srd('median(tpw)')} tpw_median, {srd('median(emiss7)')} emiss7_median,
      bool_or(refl2 is not null) has_band_2, bool_or(bt15 is not null) has_band_15, {srd('count(emiss14) / count(*)')} share_emiss14 from px group by region, scene"""))
def _(spark, sf):
    rows = scenario.ancillary_snapshot(views.pixels(spark, sf))
    return rows.select("region", "scene", "has_band_2", "has_band_15", *rds("tpw_min tpw_max tpw_median emiss7_median share_emiss14"))
