"""Checks of features, splits, model metrics, models and patches."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberframe.checks.common import Book, product, px_sql, rd, rds, srd, srds, trace
from emberframe.checks.oracle import upto
from emberframe.operators import audit, features, models, patches, scoring, splits
from emberframe.sources import views

BOOK = Book.empty()
add = BOOK.add
FIRE = f"ref_code in ({views.FIRE_LIST})"
SCENES = "(select doc_id % 50 scene, max(quality) has_fire from labels group by 1)"
MD5 = lambda key, seed="42": f"md5(concat_ws('|', '{seed}', {key}::varchar))"


def px(spark, sf):
    return views.pixels(spark, sf)


def feature_rows(spark, sf):
    return product(spark, sf, "features", lambda: features.feature_table(audit.pixel_audit(trace(spark, sf), everything=True)))


def scenes(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    return labels.groupBy(F.expr("doc_id % 50").alias("scene")).agg(F.max("quality").alias("has_fire"))


@add("f1_binary_label", px_sql(f"select event_id, ({FIRE})::int y from px"))
def _(spark, sf):
    return px(spark, sf).select("event_id", features.label(F.col("ref_code")).alias("y"))


@add("f2_scene_has_fire", px_sql(f"select scene, max(({FIRE})::int) has_fire from px group by scene"))
def _(spark, sf):
    return features.scenes_with_fire(px(spark, sf))


_SPLIT = f"""
    with s as {SCENES}, r as (select *, row_number() over (partition by has_fire order by {MD5('scene')}) k, count(*) over (partition by has_fire) n from s)
    select scene, has_fire, case when n > 1 and k <= greatest(1, least(n - 1, round_even(n * 25e-2, 0))) then 'test' else 'train' end side from r"""


@add("f3_class_split", _SPLIT)
def _(spark, sf):
    return features.split_by_class(scenes(spark, sf), 0.25).select("scene", "has_fire", "side")


@add("f4_fire_aware_split", px_sql(f"""
    , s0 as (select scene, max(({FIRE})::int) has_fire from px group by scene), c as (select *, row_number() over (partition by has_fire order by {MD5('scene')}) k from s0),
    s as (select scene, has_fire from c order by case when k <= 1 then 0 else 1 end, has_fire, {MD5('scene')} limit 3),
    r as (select *, row_number() over (partition by has_fire order by {MD5('scene')}) k, count(*) over (partition by has_fire) n from s)
    select scene, has_fire, case when n > 1 and k <= greatest(1, least(n - 1, round_even(n * 25e-2, 0))) then 'test' else 'train' end side from r"""))
def _(spark, sf):
    return features.fire_aware_split(px(spark, sf), 0.25, max_scenes=3).select("scene", "has_fire", "side")


def split_table(spark, sf):
    named = features.split_by_class(scenes(spark, sf), 0.25).withColumn("split_id", F.lit("a"))
    return named.select("split_id", "scene", "side")


@add("f5_content_id", f"""
    with sp as ({_SPLIT}) select side, substr(sha1(string_agg(s, '|' order by s)), 1, 8) content_id, count(*) n_scenes from (select distinct side, scene::varchar s from sp) group by side""")
def _(spark, sf):
    rows = split_table(spark, sf).withColumn("name", F.col("scene").cast("string"))
    return features.content_id(rows, ["side"], "name")


@add("f6_split_problems", "select 'a' split_id, doc_id % 50 scene from labels where quality = 1 intersect select 'a', doc_id % 50 from labels where toxic = 1")
def _(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    sides = F.array_compact(F.array(F.when(F.col("quality") == 1, "train"), F.when(F.col("toxic") == 1, "test")))
    return features.split_problems(labels.select(F.lit("a").alias("split_id"), F.expr("doc_id % 50").alias("scene"), F.explode(sides).alias("side")))


@add("f6_split_load", f"with sp as ({_SPLIT}) select distinct 'a' split_id, scene, side from sp")
def _(spark, sf):
    """The split as labels name it, a row a label, loaded as a split of scenes."""
    labels = spark.read.parquet(f"{sf}/labels.parquet").select(F.expr("doc_id % 50").alias("scene"))
    return features.load_split(split_table(spark, sf).join(labels, "scene"))


@add("f7_balanced_sample", px_sql(f"""
    select event_id from (select event_id, row_number() over (partition by region, scene, {FIRE} order by {MD5('event_id')}) k from px where bt7 is not null and bt14 is not null) where k <= 40"""))
def _(spark, sf):
    rows = px(spark, sf).where("bt7 is not null and bt14 is not null").withColumn("y", features.label(F.col("ref_code")))
    return features.balanced_sample(rows, ["region", "scene", "y"], 40, F.col("event_id")).select("event_id")


_NIGHT_NAMES = ("bt7", "bt14e", "bt15", "albedo", "refl", "refl2", "tpw", "sza", "lza", "glint", "emiss7", "emiss14", "eco_code", "bt7_bkg", "bt7_bkg_std", "bt14_bkg", "bt14_bkg_std",
                "albedo_bkg", "reflb", "std_reflb", "n_passes", "rad_diff_sigma", "bt7_corr", "bt14_corr")
_EMPTY = ", ".join(f"case when count({n}) = 0 then '{n}' end" for n in _NIGHT_NAMES)


@add("f9_empty_features", upto("mask", f"""
    select unnest(list_filter([{_EMPTY}], lambda x: x is not null)) feature
    from mask where not is_day and in_roi"""))
def _(spark, sf):
    night = trace(spark, sf).where("not is_day and in_roi")
    return features.empty_features(night, _NIGHT_NAMES)


_WHOLE = ", ".join(["i", "j", f"({FIRE})::int ref_fire", "ref_code", *(f"round({srd(n, 3)} * 1000)::bigint {n}" for n in features.FEATURE_COLUMNS)])
_TEXT = ", ".join(f"coalesce({n}::varchar, 'null')" for n in ("i", "j", "ref_fire", "ref_code", *features.FEATURE_COLUMNS))


@add("f10_dataset_manifest", upto("mask", f"""
    , named as (select *, bt14e bt14_eff, glint glint_angle, bt7 - bt14e diff_bt7_bt14, bt7 - bt7_bkg bt7_minus_bkg7, bt14e - bt14_bkg bt14_minus_bkg14, refl - reflb refl_minus_reflb
      from mask where in_roi),
    whole as (select strftime(make_timestamp(scene_epoch * 1000000), '%Y%m%d_%H%M') as timestamp, {_WHOLE} from named),
    marked as (select timestamp, ref_fire, ('0x' || substr(md5(concat_ws('|', {_TEXT})), 1, 15))::bigint digits from whole)
    select timestamp, count(*) n_rows, sum(ref_fire)::bigint n_positive, sha1(sum(digits)::varchar) content_hash from marked group by timestamp"""))
def _(spark, sf):
    """Values enter in whole thousandths, which engines print alike."""
    names = features.FEATURE_COLUMNS
    whole = feature_rows(spark, sf).select("timestamp", "i", "j", "ref_fire", "ref_code", *[F.round(rd(n, 3) * 1000).cast("long").alias(n) for n in names])
    return features.dataset_manifest(whole, ("i", "j", "ref_fire", "ref_code", *names))


@add("f11_scene_coverage", f"with sp as ({_SPLIT}) select 'a' split_id, scene, side from sp where scene not in (select distinct event_id // 500 from events)")
def _(spark, sf):
    have = views.events(spark, sf).select(F.expr("event_id div 500").alias("scene"))
    return features.uncovered(split_table(spark, sf), have).select("split_id", "scene", "side")


@add("f12_stratified_rows", f"""
    select doc_id, quality, case when row_number() over (partition by quality order by {MD5('doc_id')}) <= round_even(count(*) over (partition by quality) * 25e-2, 0) then 'test' else 'train' end side from labels""")
def _(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    return features.stratified_rows(labels, "quality", 0.25, F.col("doc_id")).select("doc_id", "quality", "side")


@add("s20_safe_columns", upto("mask", f"""
    select strftime(make_timestamp(scene_epoch * 1000000), '%Y%m%d_%H%M') as timestamp, i, j, ({FIRE})::int ref_fire, ref_code, {srds('bt7 bt7_bkg albedo refl', 3)}, {srd('bt14e', 3)} bt14_eff, n_passes
    from mask where in_roi"""))
def _(spark, sf):
    return feature_rows(spark, sf).select("timestamp", "i", "j", "ref_fire", "ref_code", *rds("bt7 bt7_bkg albedo refl bt14_eff", 3), "n_passes")


# Exact trees ------------------------------------------------------------------------------------------------------------
_TREE_FEATURES, _TREE_DEPTH, _TREE_LEAF = ("bt7", "bt7_bkg", "bt14_eff", "albedo", "refl", "n_passes"), 3, 5


def _tree_sql(body: str) -> str:
    """Level by level: t<d> the rows with their node, b<d> the best boundary of each node."""
    exact = ", ".join(f"coalesce({srd('bt14e' if f == 'bt14_eff' else f, 3)}, '-inf'::double) {f}" for f in _TREE_FEATURES)
    parts = [f"""t0 as materialized (select 1 node, ref_fire y, {", ".join(_TREE_FEATURES)} from (select ({FIRE})::int ref_fire, {exact} from mask where in_roi)),
      w as (select count(*) / (2e0 * sum(1 - y)) w0, count(*) / (2e0 * sum(y)) w1 from t0)"""]
    gini = lambda a, b: f"(1 - ({a} * {a} + {b} * {b}) / (({a} + {b}) * ({a} + {b})))"
    for d in range(_TREE_DEPTH):
        long = " union all ".join(f"select node, {k} place, '{f}' feature, {f} as value, y from t{d}" for k, f in enumerate(_TREE_FEATURES))
        parts.append(f"""b{d} as materialized (select node, arg_max(struct_pack(feature := feature, threshold := (value + above) / 2, gain := gain), (gain, -place, -value)) s
          from (select *, round({gini('e', 'f')} - ((a + b) * {gini('a', 'b')} + (c + d) * {gini('c', 'd')}) / (e + f), 10) gain
            from (select node, place, feature, value, above, l0 * w0 a, l1 * w1 b, (n0 - l0) * w0 c, (n1 - l1) * w1 d, n0 * w0 e, n1 * w1 f
              from (select *, sum(c0) over o l0, sum(c1) over o l1, sum(c0) over (partition by node, place) n0, sum(c1) over (partition by node, place) n1, lead(value) over o above
                from (select node, place, feature, value, sum(1 - y) c0, sum(y) c1 from ({long}) group by all) window o as (partition by node, place order by value)), w
              where l0 + l1 >= {_TREE_LEAF} and n0 + n1 - l0 - l1 >= {_TREE_LEAF})) where gain > 0 group by node)""")
        value = " ".join(f"when '{f}' then {f}" for f in _TREE_FEATURES)
        parts.append(f"t{d + 1} as materialized (select 2 * node + (case s.feature {value} end > s.threshold)::int node, y, {', '.join(_TREE_FEATURES)} from t{d} join b{d} using (node))")
    nodes = " union all ".join(
        f"select node, {d} depth, {'s.feature, s.threshold, s.gain' if d < _TREE_DEPTH else 'null feature, null::double threshold, null::double gain'}, n, n0 * w0 + n1 * w1 weight, n1 * w1 / (n0 * w0 + n1 * w1) share "
        f"from (select node, count(*) n, sum(1 - y) n0, sum(y) n1 from t{d} group by node) {f'left join b{d} using (node)' if d < _TREE_DEPTH else ''}, w" for d in range(_TREE_DEPTH + 1)
    )
    return upto("mask", f", {', '.join(parts)}, nodes as ({nodes}) {body}")


def exact_tree(spark, sf):
    return product(spark, sf, "exact_tree", lambda: splits.grow(
        feature_rows(spark, sf).select("ref_fire", *(rd(f, 3).alias(f) for f in _TREE_FEATURES)), _TREE_FEATURES, "ref_fire", _TREE_DEPTH, _TREE_LEAF
    ))


@add("m1_exact_tree", _tree_sql(f"select node, depth, feature, {srd('threshold', 4)} threshold, n, {srd('weight', 4)} weight, {srd('share', 6)} share, {srd('gain', 6)} gain from nodes"))
def _(spark, sf):
    return exact_tree(spark, sf).select("node", "depth", "feature", "n", rd("threshold", 4).alias("threshold"), rd("weight", 4).alias("weight"), *rds("share gain", 6))


@add("m9_exact_importances", _tree_sql(f"select feature, {srd('sum(weight * gain) / any_value(al)', 6)} importance from (select *, sum(weight * gain) over () al from nodes where feature is not null) group by feature"))
def _(spark, sf):
    return splits.importances(exact_tree(spark, sf)).select("feature", rd("importance", 6).alias("importance"))


# Model metrics over the labels: the score is a function of the document's length -----------------------------------------
_SCORED = "select doc_id % 20 scene, quality y, (n_chars % 997) / 1e3 score, case when (n_chars % 997) / 1e3 > 4e-1 then 1 else 0 end p from {labels} join {documents} using (doc_id)"
_SCORED_SQL = _SCORED.format(labels="labels", documents="documents")


def scored(spark, sf):
    return spark.sql(_SCORED, labels=spark.read.parquet(f"{sf}/labels.parquet"), documents=spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "n_chars"))


_CELLS = "count(*) filter (where y = 1 and p = 1) tp, count(*) filter (where y = 0 and p = 1) fp, count(*) filter (where y = 1 and p = 0) fn, count(*) filter (where y = 0 and p = 0) tn"


@add("m4_row_metrics", f"""
    select tp, fp, fn, tn, {srd('(tp + tn) / (tp + tn + fp + fn)')} accuracy, {srd('(tp / (tp + fn) + tn / (tn + fp)) / 2')} balanced_accuracy, {srd('tp / (tp + fp)')} as precision,
      {srd('tp / (tp + fn)')} recall, {srd('2 * tp / (2 * tp + fp + fn)')} f1 from (select {_CELLS} from ({_SCORED_SQL}))""")
def _(spark, sf):
    return scoring.row_metrics(scored(spark, sf)).select("tp", "fp", "fn", "tn", *rds("accuracy balanced_accuracy precision recall f1"))


@add("m3_macro_metrics", f"""
    with l as (select lang t, case when n_chars % 5 = 0 then 'en' else lang end q from documents), c as (select distinct t c from l),
    m as (select c, count(*) filter (where t = c and q = c) tp, count(*) filter (where t <> c and q = c) fp, count(*) filter (where t = c and q <> c) fn from l, c group by c)
    select {srd('avg(tp / nullif(tp + fp, 0))')} macro_precision, {srd('avg(tp / nullif(tp + fn, 0))')} macro_recall, {srd('avg(2 * tp / nullif(2 * tp + fp + fn, 0))')} macro_f1, count(*) n_classes from m""")
def _(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("lang").alias("y"), F.expr("case when n_chars % 5 = 0 then 'en' else lang end").alias("p"))
    return scoring.macro_metrics(docs).select("n_classes", *rds("macro_precision macro_recall macro_f1"))


_AP = """select scene, sum(tp / pos * cum_tp / cum_n) ap from (select *, sum(tp) over (partition by scene order by score desc) cum_tp, sum(n) over (partition by scene order by score desc) cum_n,
  sum(tp) over (partition by scene) pos from (select {scene} scene, score, sum(y) tp, count(*) n from ({rows}) group by all)) group by scene"""


@add("m5_average_precision", f"select {srd('ap', 6)} average_precision from ({_AP.format(scene='0', rows=_SCORED_SQL)})")
def _(spark, sf):
    return scoring.average_precision(scored(spark, sf)).select(rd("average_precision", 6).alias("average_precision"))


@add("m5_average_precision_by_scene", f"select scene, {srd('ap', 6)} average_precision from ({_AP.format(scene='scene', rows=_SCORED_SQL)})")
def _(spark, sf):
    return scoring.average_precision(scored(spark, sf), ["scene"]).select("scene", rd("average_precision", 6).alias("average_precision"))


@add("m6_confusion_cells", f"select {_CELLS} from ({_SCORED_SQL})")
def _(spark, sf):
    return scoring.counts(scored(spark, sf))


_SCENE = f"""select *, tp + fn > 0 has_fire, tp + fp > 0 alarm, tp / nullif(tp + fn, 0) recall, tp / nullif(tp + fp, 0) as precision,
    case when tp + fn + fp > 0 then 2 * tp / (2 * tp + fp + fn) end f1 from (select scene, {_CELLS} from ({_SCORED_SQL}) group by scene)"""


@add("m7_scene_scores", f"select scene, tp, fp, fn, tn, has_fire, alarm, {srds('recall precision f1').replace('as precision', 'as precision')} from ({_SCENE})")
def _(spark, sf):
    return scoring.scene_scores(scored(spark, sf)).select("scene", "tp", "fp", "fn", "tn", "has_fire", "alarm", *rds("recall precision f1"))


@add("m8_scene_aggregates", f"""
    select count(*) scene_count, count(*) filter (where has_fire) with_fire, count(*) filter (where not has_fire) without_fire,
      {srd('avg(fp) filter (where not has_fire)')} fp_per_clear_scene, count(*) filter (where has_fire and not alarm) missed_scenes,
      count(*) filter (where has_fire and tp = 0) hit_missed, 6e-1 recall_target,
      {srd('2 * avg(alarm::int) filter (where has_fire) * avg(has_fire::int) filter (where alarm) / (avg(alarm::int) filter (where has_fire) + avg(has_fire::int) filter (where alarm))')} alarm_f1, {srd('avg(recall) filter (where has_fire)')} macro_recall, {srd('avg(precision)')} macro_precision,
      {srd('min(recall) filter (where has_fire)')} worst_recall, {srd('avg((recall >= 6e-1)::int) filter (where has_fire)')} meeting_target, {srd('avg(fp)')} fp_per_scene, {srd('median(fp)')} fp_median,
      max(fp) fp_max, {srd('avg(alarm::int) filter (where has_fire)')} alarm_recall, {srd('avg(has_fire::int) filter (where alarm)')} alarm_precision,
      count(*) filter (where alarm and not has_fire) false_alarm_scenes, {srd('avg((tp > 0)::int) filter (where has_fire)')} hit_recall from ({_SCENE})""")
def _(spark, sf):
    table = scoring.scene_aggregates(scoring.scene_scores(scored(spark, sf)), 0.6)
    return table.select("scene_count", "with_fire", "without_fire", "missed_scenes", "hit_missed", "recall_target", "fp_max", "false_alarm_scenes",
                        *rds("macro_recall macro_precision worst_recall meeting_target fp_per_scene fp_per_clear_scene fp_median alarm_recall alarm_precision alarm_f1 hit_recall"))


@add("m10_threshold_choice", f"""
    with r as ({_SCORED_SQL}), t as (select unnest(range(91)) k), m as (select k, scene, count(*) filter (where y = 1 and lv >= k) tp, count(*) filter (where lv >= k) n, sum(y) pos
      from (select *, floor((score - 5e-2) / 1e-2 + 1e-9) lv from r), t group by k, scene),
    g as (select k, round(k * 1e-2 + 5e-2, 2) threshold, avg(tp / nullif(pos, 0)) recall, avg(tp / nullif(n, 0)) as precision from m group by k)
    select threshold, {srd('recall')} recall, {srd('precision')} as precision, threshold = coalesce((select max(threshold) from g where recall >= 8e-1), (select arg_max(threshold, (recall, threshold)) from g)) chosen from g""")
def _(spark, sf):
    return scoring.choose_threshold(scored(spark, sf), 0.8).select("threshold", "chosen", *rds("recall precision"))


_EDGE = """select event_id, (refl2 - 1e-1) / (refl2 + 1e-1) ndvi, bt14 temp from {px} where refl2 is not null and bt14 is not null"""


@add("m12_dry_edge", px_sql(f"""
    , e as ({_EDGE.format(px='px')}), b as (select min(ndvi) lo, max(ndvi) hi from e), q as (select *, greatest(ceil((ndvi - lo) / (hi - lo) * 50) - 1, 0) bin from e, b),
    g as (select bin, quantile_cont(temp, 98e-2) dry, quantile_cont(temp, 2e-2) wet, any_value(lo + (bin + 5e-1) * (hi - lo) / 50) x from q group by bin),
    l as (select regr_slope(dry, x) slope, regr_intercept(dry, x) icept, avg(wet) wet from g)
    select event_id, {srd('least(greatest((temp - wet) / (icept + slope * ndvi - wet), 0), 1)', 3)} "index" from e, l"""))
def _(spark, sf):
    rows = spark.sql(_EDGE, px=px(spark, sf))
    return scoring.dry_edge(rows, "ndvi", "temp").select("event_id", rd("index", 3).alias("index"))


# Models: no other engine grows the same trees, so these are checked by rows and by tests ------------------------------------
_MODEL_SETS = {
    "spectral": ("bt7", "bt14_eff", "albedo", "refl", "diff_bt7_bt14"),
    "contextual": ("bt7_bkg", "bt14_bkg", "bt7_minus_bkg7", "bt14_minus_bkg14", "refl_minus_reflb"),
}
_MODEL_FEATURES = models.resolve_features(_MODEL_SETS, ("spectral", "contextual"))


def _training(spark, sf):
    rows = feature_rows(spark, sf).withColumn("scene", F.col("timestamp"))
    return rows


def _model_metrics(spark, sf, **options):
    """Whole scenes train or test; weights and empty features are judged on the training side alone."""
    rows = _training(spark, sf).select("scene", "i", "j", "ref_fire", *_MODEL_FEATURES)
    train, test = models.scene_sides(rows, "ref_fire")
    names = models.usable(train, _MODEL_FEATURES)
    model = models.tree_pipeline(names, "ref_fire", **options).fit(models.balance_weights(train, "ref_fire"))
    return model, names, scoring.row_metrics(models.predict(model, test.withColumn("weight", F.lit(1.0))), truth="ref_fire")


@add("m1_decision_tree")
def _(spark, sf):
    return _model_metrics(spark, sf)[2]


@add("m2_random_forest")
def _(spark, sf):
    return _model_metrics(spark, sf, kind="forest")[2]


@add("m3_categorical_tree")
def _(spark, sf):
    """Fitted on three quarters of each class, scored on the rest."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "source", F.col("n_chars").cast("double").alias("n_chars"))
    rows = features.stratified_rows(docs.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id"), "quality", 0.25, F.col("doc_id"))
    model = models.categorical_pipeline(["lang", "source"], ["n_chars"], "quality").fit(rows.where("side = 'train'"))
    scored = model.transform(rows.where("side = 'test'")).withColumn("prediction", F.col("prediction").cast("int"))
    return scoring.macro_metrics(scored, truth="quality", pred="prediction")


@add("m9_importances")
def _(spark, sf):
    model, names, _ = _model_metrics(spark, sf)
    return models.importances(model, names, feature_rows(spark, sf))


@add("m10_balanced_folds", """
    with s as (select doc_id // 20 scene, count(*) n_rows, count(*) filter (quality = 1) n_positive from labels group by 1),
    k as (select *, (row_number() over (order by n_positive desc, n_rows desc, scene) - 1) % 10 turn from s)
    select scene, n_rows, n_positive, (case when turn < 5 then turn else 9 - turn end)::int fold from k""")
def _(spark, sf):
    """Scenes are runs of twenty ids of the labels."""
    return models.balanced_folds(spark.read.parquet(f"{sf}/labels.parquet").withColumn("scene", F.expr("doc_id div 20")), "quality")


@add("m10_out_of_fold")
def _(spark, sf):
    rows = _training(spark, sf)
    scores = models.out_of_fold(rows, models.tree_pipeline(models.usable(rows, _MODEL_FEATURES), "ref_fire"), "ref_fire")
    return scoring.choose_threshold(scores, 0.8, truth="ref_fire")


# Patches ----------------------------------------------------------------------------------------------------------------
@add("x1_indices", px_sql(f"select event_id, {srd('(refl2 - rad7) / nullif(refl2 + rad7, 0)')} ndvi, {srd('(bt7 - bt14) / nullif(bt7 + bt14, 0)', 6)} nbr, {srd('(bt14 - bt15) / nullif(bt14 + bt15, 0)', 6)} ndmi, {srd('(bt7 - bt15) / nullif(bt7 + bt15, 0)', 6)} ndii7 from px"))
def _(spark, sf):
    nd = patches.normalised_difference
    return px(spark, sf).select("event_id", rd(nd(F.col("refl2"), F.col("rad7"))).alias("ndvi"), rd(nd(F.col("bt7"), F.col("bt14")), 6).alias("nbr"),
                                 rd(nd(F.col("bt14"), F.col("bt15")), 6).alias("ndmi"), rd(nd(F.col("bt7"), F.col("bt15")), 6).alias("ndii7"))


_PATCH = px_sql("""
    , e as (select region, scene, max(i) + 1 h, max(j) + 1 w from px group by region, scene),
    o as (select region, scene, y py, x px_ from e, (select unnest(range(0, 1000)) y), (select unnest(range(0, 1000)) x) where y * 8 + 16 <= h and x * 8 + 16 <= w),
    f as (select o.region, o.scene, p.scene_epoch, py, px_ px, avg(bt7 - bt14) mean, stddev_pop(bt7 - bt14) std, max(bt7 - bt14) high, min(bt7 - bt14) low, quantile_cont(bt7 - bt14, 95e-2) p95,
      quantile_cont(bt7 - bt14, 99e-2) p99, max(bt7 - bt14) - avg(bt7 - bt14) excess, count(*) n, bool_or(ref_code in (13, 14, 15)) any_fire, count(*) filter (where ref_code in (13, 14, 15)) n_fire
      from o join px p on p.region = o.region and p.scene = o.scene and p.i >= py * 8 and p.i < py * 8 + 16 and p.j >= px_ * 8 and p.j < px_ * 8 + 16 group by all)""")


def patch_rows(spark, sf):
    return patches.to_patches(px(spark, sf).withColumn("v", F.col("bt7") - F.col("bt14")), 16, 8)


def patch_table(spark, sf):
    return patches.patch_features(patch_rows(spark, sf), "v")


@add("x2_patches", f"{_PATCH} select region, scene, py, px, n from f")
def _(spark, sf):
    return patch_rows(spark, sf).groupBy("region", "scene", "py", "px").agg(F.count("*").alias("n"))


@add("x3_patch_statistics", f"{_PATCH} select region, scene, py, px, {srds('mean std high low p95 p99 excess', 3)} from f")
def _(spark, sf):
    return patch_table(spark, sf).select("region", "scene", "py", "px", *rds("mean std high low p95 p99 excess", 3))


@add("x4_patch_labels", f"{_PATCH} select region, scene, py, px, any_fire, n_fire from f")
def _(spark, sf):
    return patch_table(spark, sf).select("region", "scene", "py", "px", "any_fire", "n_fire")


@add("x5_histories", f"""{_PATCH} select region, scene, py, px, {srd('a', 3)} first_mean, {srd('b', 3)} last_mean, target from (select *, lag(mean) over w a, mean b, lead(any_fire, 1) over w target, row_number() over w k
    from f window w as (partition by region, py, px order by scene_epoch)) where k >= 2 and target is not null""")
def _(spark, sf):
    # Two scenes of history need three of a region; smaller data gives no row on either side.
    rows = patches.histories(patch_table(spark, sf), 2, 1)
    return rows.select("region", "scene", "py", "px", rd(F.col("history")[0], 3).alias("first_mean"), rd(F.col("history")[1], 3).alias("last_mean"), "target")


_LAGS, _LEADS = (0, 1, 2), (1, 2)


def _information_sql(feature: str, lead: int) -> str:
    lags = ", ".join(f"lag(bin, {n}) over x b{n}" for n in _LAGS)
    long = " union all ".join(f"select {n} lag, b{n} bin, target from w where target is not null and b{n} is not null" for n in _LAGS)
    return f"""(with q as (select quantile_cont({feature}, [25e-2, 5e-1, 75e-2]) e from f where {feature} is not null),
      b as (select *, ({feature} > e[1])::int + ({feature} > e[2])::int + ({feature} > e[3])::int bin from f, q where {feature} is not null),
      w as (select {lags}, lead(any_fire, {lead}) over x target from b window x as (partition by region, py, px order by scene_epoch)), l as ({long}),
      m as (select lag, count(*) n, bin, target from l group by all),
      t as (select *, sum(n) over (partition by lag) tot, sum(n) over (partition by lag, bin) nb, sum(n) over (partition by lag, target) nt from m)
      select '{feature}' feature, {lead} lead, lag, round(sum(n / tot * ln((n / tot) / ((nb / tot) * (nt / tot)))) + 1.7e-09, 6) + 0e0 mi from t group by lag)"""


@add("x6_mutual_information", f"{_PATCH} " + " union all ".join(f"select * from {_information_sql(feature, lead)}" for feature in patches.PATCH_FEATURES for lead in _LEADS))
def _(spark, sf):
    table, parts = product(spark, sf, "patches", lambda: patch_table(spark, sf)), None
    for feature in patches.PATCH_FEATURES:
        for lead in _LEADS:
            part = patches.information_by_lag(table, _LAGS, lead, value=feature)
            part = part.select(F.lit(feature).alias("feature"), F.lit(lead).alias("lead"), "lag", rd("mi", 6).alias("mi"))
            parts = part if parts is None else parts.unionByName(part)
    return parts


def _nearest_sql(long: str, groups: str) -> str:
    """Every row against all rows of its group, from rows (groups, value, target); digamma as harmonic sums."""
    psi = lambda n: f"list_sum(list_transform(range(1, {n}), lambda x: 1e0 / x))"
    psi = lambda n, of=psi: f"(coalesce({of(n)}, 0) - 5772156649015329e-16)"
    return f"""l as materialized (select {groups}, target, round(value * 1e6)::bigint v, row_number() over () id, count(*) over (partition by {groups}, target) size
        from ({long}) where value is not null and target is not null),
      d as (select {groups}, a.id, least(3, a.size - 1) k, a.size, list_sort(list(abs(a.v - b.v)))[least(3, a.size - 1)] r
        from l a join l b using ({groups}, target) where a.id <> b.id group by {groups}, a.id, a.size),
      m as (select {groups}, d.id, d.k, d.size, count(*) m from d join l a using ({groups}, id) join l b using ({groups}) where b.size > 1 and (abs(a.v - b.v) < r or a.v = b.v) group by {groups}, d.id, d.k, d.size),
      i as (select {groups}, count(*) n, greatest(0, {psi("count(*)")} + avg({psi("k")}) - avg({psi("size")}) - avg({psi("m")})) mi from m group by {groups})"""


_NEAREST_LONG = " union all ".join(
    f"select '{feature}' feature, {lead} lead, {lag} lag, lag({feature}, {lag}) over x as value, lead(any_fire, {lead}) over x target from f window x as (partition by region, py, px order by scene_epoch)"
    for feature in patches.PATCH_FEATURES for lead in _LEADS for lag in _LAGS
)


@add("x6_nearest_information", f"{_PATCH}, {_nearest_sql(_NEAREST_LONG, 'feature, lead, lag')} select feature, lead, lag, n, {srd('mi', 6)} mi from i")
def _(spark, sf):
    found = patches.nearest_information_by_lag(product(spark, sf, "patches", lambda: patch_table(spark, sf)), _LAGS, _LEADS)
    return found.select("feature", "lead", "lag", "n", rd("mi", 6).alias("mi"))


_OF = lambda groups: f"sum(n / tot * ln((n / tot) / ((nb / tot) * (nt / tot)))) from (select *, sum(n) over (partition by {groups}) tot, sum(n) over (partition by {groups}, bin) nb, sum(n) over (partition by {groups}, target) nt"


@add("x7_permutation_test", f"""{_PATCH}, q as (select quantile_cont(mean, [25e-2, 5e-1, 75e-2]) e from f),
    b as (select *, (mean > e[1])::int + (mean > e[2])::int + (mean > e[3])::int bin from f, q),
    x as (select bin, row_number() over (order by {MD5("region || '|' || scene || '|' || py || '|' || px", '42-x')}) k from b),
    y as (select shuffle, any_fire target, row_number() over (partition by shuffle order by {MD5("shuffle || '|' || region || '|' || scene || '|' || py || '|' || px", '42-y')}) k
      from b, (select unnest(range(1, 51)) shuffle)),
    j as (select shuffle, bin, target, count(*) n from x join y using (k) group by all),
    s as (select shuffle, {_OF('shuffle')} from j) group by shuffle), r as (select {_OF('1')} from (select bin, any_fire target, count(*) n from b group by all))),
    z as (select avg(mi) null_mean, stddev_pop(mi) null_std, count(*) n_shuffles from s as s(shuffle, mi)), seen as (select observed from r as r(observed))
    select n_shuffles, {srd('null_mean', 6)} null_mean, {srd('null_std', 6)} null_std, {srd('observed', 6)} observed, {srd('(observed - null_mean) / nullif(null_std, 0)', 3)} z from z, seen""")
def _(spark, sf):
    rows = patches.binned(patch_table(spark, sf), "mean", 4)
    table = patches.permutation_test(rows, ["region", "scene", "py", "px"], "any_fire", shuffles=50)
    return table.select("n_shuffles", *rds("null_mean null_std observed", 6), rd("z", 3).alias("z"))


_SHUFFLED = f"""select shuffle, value, target from
      (select shuffle, mean as value, row_number() over (partition by shuffle order by {MD5("region || '|' || scene || '|' || py || '|' || px", '42-x')}) k from f, (select unnest(range(1, 51)) shuffle) where mean is not null)
      join (select shuffle, any_fire target, row_number() over (partition by shuffle order by {MD5("shuffle || '|' || region || '|' || scene || '|' || py || '|' || px", '42-y')}) k
        from f, (select unnest(range(1, 51)) shuffle) where mean is not null) using (shuffle, k)
      union all select 0, mean, any_fire from f"""


@add("x7_nearest_permutation", f"""{_PATCH}, {_nearest_sql(_SHUFFLED, 'shuffle')},
    z as (select count(*) filter (shuffle > 0) n_shuffles, avg(mi) filter (shuffle > 0) null_mean, stddev_pop(mi) filter (shuffle > 0) null_std, max(mi) filter (shuffle = 0) observed from i)
    select n_shuffles, {srd('null_mean', 6)} null_mean, {srd('null_std', 6)} null_std, {srd('observed', 6)} observed, {srd('(observed - null_mean) / nullif(null_std, 0)', 3)} z from z""")
def _(spark, sf):
    rows = product(spark, sf, "patches", lambda: patch_table(spark, sf))
    table = patches.nearest_permutation_test(rows, ["region", "scene", "py", "px"], "mean", "any_fire")
    return table.select("n_shuffles", *rds("null_mean null_std observed", 6), rd("z", 3).alias("z"))


@add("x8_chronological_split", px_sql("""
    select scene, case when rank() over (order by scene) <= 8e-1 * count(*) over () then 'train' else 'test' end side, n from (select scene, count(*) n from px group by scene)"""))
def _(spark, sf):
    return patches.chronological_split(px(spark, sf).select("scene")).groupBy("scene", "side").agg(F.count("*").alias("n"))
