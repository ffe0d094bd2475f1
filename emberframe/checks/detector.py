"""Checks of radiometry, gates, background, thresholds, corrections, retrieval and confirmation."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberframe import codes as k
from emberframe.checks.common import Book, gated, px_sql, rd, rds, srd, srds, trace
from emberframe.checks.oracle import lum, tmp, upto
from emberframe.functions import radiometry as rm
from emberframe.functions.nulls import recover_unsigned
from emberframe.functions.settle import settle
from emberframe.operators import background, confirm, corrections, gates, newton, retrieval, thresholds
from emberframe.plans import detect
from emberframe.sources import views

BOOK = Book.empty()
add = BOOK.add
IJ = ["region", "scene", "i", "j"]


def k7():
    return rm.BandCoefficients.of(7)


def k14():
    return rm.BandCoefficients.of(14)


# Radiometry ---------------------------------------------------------------------------------------------------------
@add("r1_radiance_to_temperature", px_sql(f"select event_id, {srd(tmp('7', 'rad7'))} t7, {srd(tmp('14', 'rad14'))} t14 from px"))
def _(spark, sf):
    px = views.pixels(spark, sf)
    return px.select("event_id", rd(rm.temperature_of(F.col("rad7"), k7())).alias("t7"),
                     rd(rm.temperature_of(F.col("rad14"), k14())).alias("t14"))


@add("r2_temperature_to_radiance", px_sql(f"select event_id, {srd(lum('7', 'bt7'), 6)} l7, {srd(lum('14', 'bt14'))} l14 from px"))
def _(spark, sf):
    px = views.pixels(spark, sf)
    return px.select("event_id", rd(rm.radiance_of(F.col("bt7"), k7()), 6).alias("l7"),
                     rd(rm.radiance_of(F.col("bt14"), k14())).alias("l14"))


_BANDS = "(select 7 band, 3.9e-6 wl union all select 13, 10.35e-6 union all select 14, 11.2e-6 union all select 15, 12.3e-6)"


@add("r3_monochromatic_planck", px_sql(f"""
    select event_id, band, {srd('ln(rad)', 6)} log_radiance,
      {srd("(6.62607015e-34 * 299792458e0 / 1.380649e-23 / wl) / ln(1 + c1 / (rad * pow(wl, 5)))", 3)} temperature
    from (select event_id, band, wl, 2e0 * 6.62607015e-34 * 299792458e0 * 299792458e0 c1, 2e0 * 6.62607015e-34 * 299792458e0 * 299792458e0
        / (pow(wl, 5) * (exp(6.62607015e-34 * 299792458e0 / 1.380649e-23 / (wl * bt14)) - 1)) rad
      from px, {_BANDS} where bt14 is not null)"""))
def _(spark, sf):
    px = views.pixels(spark, sf).where("bt14 is not null")
    bands = F.array(*[F.struct(F.lit(b).alias("band"), F.lit(k.WAVELENGTH_M[b]).alias("wl")) for b in (7, 13, 14, 15)])
    px = px.select("event_id", "bt14", F.inline(bands))
    rad = rm.mono_radiance(F.col("bt14"), F.col("wl"))
    return px.withColumn("rad", rad).select(
        "event_id", "band", rd(F.ln("rad"), 6).alias("log_radiance"),
        rd(rm.mono_temperature(F.col("rad"), F.col("wl")), 3).alias("temperature"),
    )


@add("r4_radiance_slope", px_sql(f"""
    select event_id, {srd("p * fk1_7 * fk2_7 * bc2_7 * exp(-x) / (u * u * (1 - exp(-x)) * (1 - exp(-x)))", 8)} slope,
      {srd("ln(p * 2e0 * h * c * c * h * c / b / (pow(wl, 6) * bt7 * bt7) * exp(y) / ((exp(y) - 1) * (exp(y) - 1)))", 6)} log_mono_slope
    from (select *, fk2_7 / u x, h * c / b / (wl * bt7) y from (select event_id, bt7, fk1_7, fk2_7, bc2_7, bt7 * bc2_7 + bc1_7 u,
      1e-2 * (1 + event_id % 50) p, 6.62607015e-34 h, 299792458e0 c, 1.380649e-23 b, 3.9e-6 wl from px where bt7 is not null))"""))
def _(spark, sf):
    px = views.pixels(spark, sf).where("bt7 is not null").withColumn("p", F.expr("1e-2 * (1 + event_id % 50)"))
    return px.select("event_id", rd(rm.radiance_slope(F.col("bt7"), F.col("p"), k7()), 8).alias("slope"),
                     rd(F.ln(rm.mono_slope(F.col("bt7"), F.col("p"), F.lit(k.WAVELENGTH_M[7]))), 6).alias("log_mono_slope"))


@add("r5_native_to_si", px_sql(f"select event_id, {srd('rad7 * 1e-5 / (3.9e-6 * 3.9e-6)', 2)} si from px"))
def _(spark, sf):
    return views.pixels(spark, sf).select("event_id", rd(rm.native_to_si(F.col("rad7"), k.WAVELENGTH_M[7]), 2).alias("si"))


@add("r6_hybrid_longwave", upto("long2", f"select event_id, use_ch13, {srds('bt14e rad14e')} from long2"))
def _(spark, sf):
    return gates.effective_longwave(views.pixels(spark, sf)).select("event_id", "use_ch13", *rds("bt14e rad14e"))


@add("r7_reflectivity_product", upto("prep", f"select event_id, {srds('refl', 6)} from prep"))
def _(spark, sf):
    return gates.reflectivity_product(gates.effective_longwave(views.pixels(spark, sf))).select("event_id", *rds("refl", 6))


@add("r8_day_quantities", upto("prep", f"select event_id, is_day, {srds('cos_sza vis albedo')} from prep"))
def _(spark, sf):
    return gates.day_quantities(views.pixels(spark, sf)).select("event_id", "is_day", *rds("cos_sza vis albedo"))


# Part I gates -------------------------------------------------------------------------------------------------------
@add("p1_hard_gates", upto("gated", "select event_id, hard as code from gated"))
def _(spark, sf):
    px = views.pixels(spark, sf).withColumn("eco_code", recover_unsigned(F.col("eco_byte")))
    return gates.prepare(px).select("event_id", gates.hard_gate()["code"].alias("code"))


@add("p2_minimum_difference", upto("gated", """
    select scene, count(*) filter (where hard = 100) warm_stopped, count(*) filter (where hard = 201) cold_stopped from gated group by scene"""))
def _(spark, sf):
    return gated(spark, sf).groupBy("scene").agg(
        F.count_if((F.col("code") == 100) & (F.col("stage") == 6)).alias("warm_stopped"),
        F.count_if(F.col("code") == 201).alias("cold_stopped"),
    )


@add("p3_cloud_temperature", upto("gated", """
    select event_id, case when cloud in (200, 205, 210) then cloud end cloud from gated where bt7 is not null"""))
def _(spark, sf):
    px = gates.prepare(views.pixels(spark, sf)).where("bt7 is not null")
    return px.select("event_id", F.when(gates.cloud_code().isin(200, 205, 210), gates.cloud_code()).alias("cloud"))


@add("p4_cloud_albedo", upto("gated", "select scene, count(*) filter (where code = 215) bright, count(*) n from gated group by scene"))
def _(spark, sf):
    return gated(spark, sf).groupBy("scene").agg(F.count_if(F.col("code") == 215).alias("bright"), F.count("*").alias("n"))


@add("p5_split_window", upto("gated", "select event_id, cloud from gated where cloud >= 220"))
def _(spark, sf):
    px = gates.prepare(views.pixels(spark, sf)).withColumn("cloud", gates.cloud_code())
    return px.where("cloud >= 220").select("event_id", "cloud")


@add("p6_along_scan", upto("gated", f"""
    select event_id, {srds('refl_m3 refl_p3', 6)}, case when code in (240, 245) then code end along from gated"""))
def _(spark, sf):
    px = gated(spark, sf)
    return px.select("event_id", *rds("refl_m3 refl_p3", 6), F.when(F.col("code").isin(240, 245), F.col("code")).alias("along"))


@add("p7_saturation", upto("gated", "select event_id, case when sat_flag then 7 else -1 end fail_char from gated where survivor"))
def _(spark, sf):
    return gated(spark, sf).where("survivor").select("event_id", "fail_char")


@add("p8_background_validity", upto("gated", "select event_id, valid from gated"))
def _(spark, sf):
    return gates.prepare(views.pixels(spark, sf)).select("event_id", gates.valid_background().alias("valid"))


_LEVELS = [h for h in k.HALF_WIDTHS]
_COUNT_COLUMNS = ", ".join(f"n_{h}" for h in _LEVELS)


@add("p9_expanding_window", upto("levels", f"select region, scene, i, j, {_COUNT_COLUMNS}, half_width from levels"))
def _(spark, sf):
    counts = background.valid_counts(gated(spark, sf)).where("survivor")
    return counts.select(*IJ, *[f"n_{h}" for h in _LEVELS], "half_width")


@add("bg_nvalid", upto("bkg", "select scene, half_width, count(*) n, cast(sum(n_valid) as bigint) n_valid from bkg group by all"))
def _(spark, sf):
    found = background.expanding_background(gated(spark, sf))
    return found.groupBy("scene", "half_width").agg(F.count("*").alias("n"), F.sum("n_valid").alias("n_valid"))


_BKG = {
    "p10_statistical_background": "t7_stat_mean t7_stat_std t14_stat_mean t14_stat_std diff_stat_std",
    "p11_histogram_background": "t7_hist_mean t7_hist_std t14_hist_mean t14_hist_std vis_hist_mean",
    "p12_visible_histogram": "vis_bin_mean vis_bin_std",
    "p13_background_choice": "bt7_bkg bt14_bkg bt7_bkg_std bt14_bkg_std diff_std vis_bkg",
    "p14_reflectivity_background": "reflb rad_diff_sigma",
}


def _background_check(name: str, columns: str) -> None:
    also = {"p11_histogram_background": ["n_hist"], "p13_background_choice": ["approach", "n_passes"]}.get(name, [])
    extra = "".join(f", {c}" for c in also)

    @add(name, upto("bkg", f"select region, scene, i, j{extra}, {srds(columns, 3)} from bkg where half_width is not null"))
    def _(spark, sf):
        found = background.choose_approach(background.expanding_background(gated(spark, sf)))
        return found.where("half_width is not null").select(*IJ, *also, *rds(columns, 3))


for _name, _columns in _BKG.items():
    _background_check(_name, _columns)


@add("p15_full_window", upto("prep", f"""
    select a.region, a.scene, a.i, a.j, {srd('case when count(b.bt7) = count(*) then avg(b.bt7) end', 3)} bt7_full_mean,
      {srd('case when count(b.bt7) = count(*) then stddev_pop(b.bt7) end', 3)} bt7_full_std,
      {srd('case when count(b.bt14e) = count(*) then avg(b.bt14e) end', 3)} bt14_full_mean,
      {srd('case when count(b.bt14e) = count(*) then stddev_pop(b.bt14e) end', 3)} bt14_full_std
    from prep a join prep b on a.region = b.region and a.scene = b.scene and abs(a.i - b.i) <= 5 and abs(a.j - b.j) <= 5 group by all"""))
def _(spark, sf):
    full = background.full_window(gates.prepare(views.pixels(spark, sf)), 5)
    return full.select(*IJ, *rds("bt7_full_mean bt7_full_std bt14_full_mean bt14_full_std", 3))


def _thresholds(spark, sf):
    return detect.survivors(views.pixels(spark, sf)).where("half_width is not null")


@add("p16_contextual_thresholds", upto("cls", f"select region, scene, i, j, {srds('std_7b14b std_7b std_reflb std_reflb_max', 3)} from cls where half_width is not null"))
def _(spark, sf):
    return _thresholds(spark, sf).select(*IJ, *rds("std_7b14b std_7b std_reflb std_reflb_max", 3))


@add("p17_along_scan_pass", upto("cls", "select region, scene, i, j, pass_along from cls where half_width is not null"))
def _(spark, sf):
    return _thresholds(spark, sf).select(*IJ, "pass_along")


@add("p18_background_albedo", upto("cls", f"select region, scene, i, j, {srds('albedo_bkg', 3)} from cls where half_width is not null"))
def _(spark, sf):
    return _thresholds(spark, sf).select(*IJ, *rds("albedo_bkg", 3))


# A candidate per event, spread over the value ranges in which the later rules branch -----------------------------------
_STATES = """
  select region, scene, i, j, event_id, scene_epoch, 264e0 + (event_id * 37 % 700) / 1e1 as bt7,
    262e0 + (event_id * 53 % 440) / 1e1 as bt14e, 262e0 + (event_id * 71 % 400) / 1e1 as bt7_bkg, 262e0 + (event_id * 29 % 380) / 1e1 as bt14_bkg,
    (event_id * 13 % 45) / 1e1 as bt7_bkg_std, (event_id * 17 % 35) / 1e1 as bt14_bkg_std, (event_id * 19 % 30) / 1e1 as diff_std,
    (event_id * 7 % 300) / 1e2 as refl, (event_id * 3 % 150) / 1e2 as refl_m2, (event_id * 5 % 150) / 1e2 as refl_p2,
    (event_id * 11 % 120) / 1e2 as reflb, (event_id * 23 % 90) / 1e2 as rad_diff_sigma, cast(event_id * 31 % 11 as int) as n_passes,
    cast((event_id * 31 % 11 + 1) * 5 as int) as half_width, event_id % 9 = 0 as sat_flag, event_id % 7 = 0 as is_cloudy,
    event_id % 3 > 0 as is_day, 4e-1 as cos_sza, case when event_id % 3 > 0 then 65e0 else 100e0 end as sza,
    case when event_id % 3 > 0 and event_id % 10 > 0 then (event_id * 41 % 60) / 1e2 end as albedo,
    (event_id * 43 % 200) / 1e0 as vis_bkg, (event_id * 43 % 200) / 1e0 as vis, cast(case event_id % 13 when 0 then -1 when 12 then -1 else event_id % 13 end as int) as fail_char,
    100 as code, 9 as stage, event_id % 4 = 0 as use_ch13, 95e-2 as emiss7, 97e-2 as emiss14, tpw, lza,
    case event_id % 5 when 0 then -999e0 when 1 then 0e0 when 2 then -(350 + event_id % 50) when 3 then 400e0 + event_id % 400 else -905e-2 end as fire_temp,
    (event_id % 100) / 1e3 as fire_frac, (event_id % 100) / 2e2 as fire_area, (event_id % 500) / 1e0 as frp, true as candidate,
    fk1_7, fk2_7, bc1_7, bc2_7, fk1_14, fk2_14, bc1_14, bc2_14, fk1_13, fk2_13, bc1_13, bc2_13 from {px}
"""
# Band radiances of the states; a few are out of range on purpose.
_STATE_RADS = """
  select *, case when event_id % 97 = 5 then -1e0 else fk1_7 / (exp(fk2_7 / (bt7 * bc2_7 + bc1_7)) - 1) end as rad7,
    case when event_id % 89 = 5 then 5e-3 when use_ch13 then fk1_13 / (exp(fk2_13 / (bt14e * bc2_13 + bc1_13)) - 1)
    else fk1_14 / (exp(fk2_14 / (bt14e * bc2_14 + bc1_14)) - 1) end as rad14e,
    case when use_ch13 then fk1_13 else fk1_14 end as fk1_l, case when use_ch13 then fk2_13 else fk2_14 end as fk2_l,
    case when use_ch13 then bc1_13 else bc1_14 end as bc1_l, case when use_ch13 then bc2_13 else bc2_14 end as bc2_l, 4e0 as area_km2
  from {states}
"""


def states(spark, sf):
    rows = spark.sql(_STATES, px=views.pixels(spark, sf))
    return spark.sql(_STATE_RADS, states=rows)


def on_states(step: str, body: str, first: str = "thr0") -> str:
    """The oracle's steps from `first` on, with the states in place of the background table."""
    from emberframe.checks import oracle

    state = [("px", views.pixel_sql("//")), ("states", _STATES.format(px="px")), ("bkg", f"select * exclude (fire_temp, fire_frac, fire_area, frp, fail_char, candidate) from ({_STATE_RADS.format(states='states')})")]
    chain = [*oracle.STEPS, *oracle.bisection(50), *oracle.AFTER]
    names = [n for n, _ in chain]
    chain = [*state, *[c for c in chain if c[0] == "lut"], *chain[names.index(first):]]
    out = []
    for name, sql in chain:
        out.append(f"{name} as{'' if name == 'bis' else ' materialized'} ({sql})")
        if name == step:
            break
    return f"with recursive {', '.join(out)} {body}"


def classified(spark, sf):
    return settle(thresholds.classify_survivors(thresholds.contextual_thresholds(states(spark, sf).withColumn("fail_char", F.when(F.col("sat_flag"), 7).otherwise(-1)))))


_STEP_OF = "case step0 when 'quick' then 'quick' when 'open' then 'open' when 'none' then 'none' else 'stopped' end"


@add("p19_quick_path", on_states("cls", "select event_id from cls where step0 = 'quick'"))
def _(spark, sf):
    return classified(spark, sf).where("path = 'quick'").select("event_id")


@add("p20_non_fire", on_states("cls", "select scene, count(*) filter (where step0 = 'non_fire') non_fire, count(*) n from cls group by scene"))
def _(spark, sf):
    return classified(spark, sf).groupBy("scene").agg(F.count_if(F.col("stage") == 11).alias("non_fire"), F.count("*").alias("n"))


@add("p21_flags_one_two", on_states("cls", f"""
    select event_id, {_STEP_OF} path, case step0 when 'flag_1' then 1 when 'flag_2' then 2 else case when sat_flag then 7 else -1 end end fail_char from cls"""))
def _(spark, sf):
    return classified(spark, sf).select("event_id", "path", "fail_char")


@add("p22_lut_lookup", px_sql(f"""
    , lut as (select cast(id // 7 + 1 as int) tpw_bin, cast(id % 7 + 1 as int) zenith_bin, 9e-1 - 3e-2 * (id // 7 + 1) - 1e-2 * (id % 7 + 1) trans_4um,
      1e-2 * (id // 7 + 1) offset_11um from (select unnest(range(35)) id))
    select event_id, tpw_bin, zenith_bin, {srds('trans_4um offset_11um')} from (select event_id,
      cast(least(greatest(round_even(tpw / 10, 0), 1), 5) as int) tpw_bin, cast(least(greatest(round_even(lza / 10, 0), 1), 7) as int) zenith_bin from px)
    join lut using (tpw_bin, zenith_bin)"""))
def _(spark, sf):
    px = corrections.attach_lut(views.pixels(spark, sf), views.lut(spark))
    return px.select("event_id", "tpw_bin", "zenith_bin", *rds("trans_4um offset_11um"))


def corrected(spark, sf):
    return corrections.correct(classified(spark, sf), views.lut(spark))


def _open_only(columns: str, digits: int) -> str:
    return f"select event_id, {srds(columns, digits)} from cor"


_CORRECTION_CHECKS = {
    "p23_vapour_correction": ("r7_tpw r14_tpw t7_tpw t14_tpw", "r7_tpw r14_tpw t7_tpw t14_tpw"),
    "p25_emissivity_correction": ("r7_em r14_em r7_bkg r14_bkg", "r7_em r14_em r7_bkg r14_bkg"),
    "p26_solar_correction": ("r7_from_14 r7_solar", "r7_from_14 r7_solar"),
    "p27_diffraction_correction": ("r7_diff r14_diff", "r7_diff r14_diff"),
}


def _correction_check(name: str, spark_columns: str, sql_columns: str) -> None:
    @add(name, on_states("cor", f"select event_id, {srds(sql_columns, 5)} from cor"))
    def _(spark, sf):
        rows = classified(spark, sf).where("path = 'open'")
        return corrections.correct(rows, views.lut(spark)).select("event_id", *rds(spark_columns, 5))


for _name, (_a, _b) in _CORRECTION_CHECKS.items():
    _correction_check(_name, _a, _b)


@add("p24_thin_cloud", on_states("cor", f"""
    select event_id, {srd("t7_tpw + case when is_day and ex > 25e-3 and ex < 7e-2 then 10 * ex when is_day and (albedo > 38e-2 or ex >= 7e-2) and ex is not null then 7e-1 else 0 end")} t7_cloud,
      {srd("t14_tpw + case when is_day and ex > 25e-3 and ex < 7e-2 then 30 * ex when is_day and (albedo > 38e-2 or ex >= 7e-2) and ex is not null then 21e-1 else 0 end")} t14_cloud
    from (select *, albedo - albedo_bkg ex from cor)"""))
def _(spark, sf):
    rows = classified(spark, sf).where("path = 'open'")
    return corrections.correct(rows, views.lut(spark)).select("event_id", *rds("t7_cloud t14_cloud"))


@add("p28_post_correction_flags", on_states("cor", """
    select event_id, coalesce(failed_at, 17) stage, case when failed_at is null then fail_post else case when sat_flag then 7 else -1 end end fail_char from cor"""))
def _(spark, sf):
    rows = classified(spark, sf).where("path = 'open'")
    return corrections.correct(rows, views.lut(spark)).select("event_id", "stage", "fail_char")


def retrieved(spark, sf):
    rows = corrections.correct(classified(spark, sf), views.lut(spark))
    return retrieval.size_and_power(retrieval.last_chance(retrieval.retrieve(rows)))


@add("p29_last_chance", on_states("ret3", f"select event_id, {srds('fire_temp', 2)} from ret3 where kept"))
def _(spark, sf):
    return retrieved(spark, sf).where("path = 'open'").select("event_id", *rds("fire_temp", 2))


@add("p30_fire_area", on_states("ret3", f"select event_id, {srd('fire_frac * area_km2', 5)} fire_area from ret3 where kept"))
def _(spark, sf):
    return retrieved(spark, sf).where("path = 'open'").select("event_id", *rds("fire_area", 5))


@add("p31_candidate_records", upto("p1", f"""
    select scene, cast(i * 50 + j as bigint) fire_id, fail_char, n_passes, {srds('bt7 bt14e bt7_bkg bt14_bkg std_7b std_7b14b fire_temp fire_area frp', 2)}
    from p1 where candidate"""))
def _(spark, sf):
    rows = detect.part_one(views.scene_pixels(spark, sf), views.lut(spark)).where("candidate")
    fire_id = (F.col("i").cast("long") * 50 + F.col("j")).alias("fire_id")
    return rows.select("scene", fire_id, "fail_char", "n_passes",
                       *rds("bt7 bt14e bt7_bkg bt14_bkg std_7b std_7b14b fire_temp fire_area frp", 2))


_DIAG = "refl albedo vis bt7_bkg bt14_bkg bt7_bkg_std bt14_bkg_std t7_stat_std t7_hist_std reflb rad_diff_sigma std_7b14b std_7b std_reflb std_reflb_max albedo_bkg bt7_corr bt14_corr bt7_bkg_corr bt14_bkg_corr fire_temp fire_frac frp"


@add("p32_diagnostics", upto("p1", f"""
    select region, scene, i, j, p1_stage stage, p1_code, fail_char, use_ch13, eco_code, is_cloudy, sat_flag, half_width, n_passes, n_hist,
      {srds(_DIAG, 2)} from p1"""))
def _(spark, sf):
    return trace(spark, sf).select(*IJ, "stage", "p1_code", "fail_char", "use_ch13", "eco_code", "is_cloudy", "sat_flag", "half_width",
                                   "n_passes", "n_hist", *rds(_DIAG, 2))


# Retrieval ------------------------------------------------------------------------------------------------------------
@add("c1_fire_radiance", px_sql(f"select event_id, {srd('(rad7 - (1 - p) * rad14) / p', 3)} fire_rad from (select *, 1e-2 * (1 + event_id % 99) p from px)"))
def _(spark, sf):
    px = views.pixels(spark, sf).withColumn("p", F.expr("1e-2 * (1 + event_id % 99)"))
    return px.select("event_id", rd(retrieval.fire_radiance(F.col("rad7"), F.col("rad14"), F.col("p")), 3).alias("fire_rad"))


# Mixtures of known fraction and temperature over the pixel's own background.
_MIX = """
  select event_id, region, scene, i, j, bt14 as bt14_bkg_corr, false as use_ch13, p0, t0, fk1_7, fk2_7, bc1_7, bc2_7, fk1_14, fk2_14, bc1_14, bc2_14, fk1_13, fk2_13, bc1_13, bc2_13,
    p0 * fk1_7 / (exp(fk2_7 / (t0 * bc2_7 + bc1_7)) - 1) + (1 - p0) * fk1_7 / (exp(fk2_7 / (bt14 * bc2_7 + bc1_7)) - 1) as r7_diff,
    p0 * fk1_14 / (exp(fk2_14 / (t0 * bc2_14 + bc1_14)) - 1) + (1 - p0) * fk1_14 / (exp(fk2_14 / (bt14 * bc2_14 + bc1_14)) - 1) as r14_diff
  from (select *, 23e-5 * (1 + event_id % 100) as p0, 410e0 + event_id * 7 % 600 as t0 from {px} where bt14 is not null)
"""
_MIX_DZ = f"""
  select *, fk1_14 fk1_l, fk2_14 fk2_l, bc1_14 bc1_l, bc2_14 bc2_l, fk1_7 / (exp(fk2_7 / (bt14_bkg_corr * bc2_7 + bc1_7)) - 1) b7,
    fk1_14 / (exp(fk2_14 / (bt14_bkg_corr * bc2_14 + bc1_14)) - 1) bl from ({_MIX})
"""


def _mix_sql(steps: int, body: str) -> str:
    from emberframe.checks import oracle

    parts = [("px", views.pixel_sql("//")), ("dz", _MIX_DZ.format(px="px")), *oracle.bisection(steps)]
    return "with recursive " + ", ".join(f"{n} as ({s})" for n, s in parts) + " " + body


@add("c2_bisection", _mix_sql(15, f"select region, scene, i, j, {srd('ln(p)', 6)} log_p, {srd('t', 3)} t from root where p is not null"))
def _(spark, sf):
    rows = settle(retrieval.bisect_fraction(spark.sql(_MIX, px=views.pixels(spark, sf)), 15))
    return rows.where("p_15 is not null").select(*IJ, rd(F.ln("p_15"), 6).alias("log_p"), rd("t_15", 3).alias("t"))


@add("c3_refined_solution", px_sql(f"select event_id, {srd('p0', 6)} p, {srd('t0', 2)} t from ({_MIX.format(px='px')})"))
def _(spark, sf):
    rows = retrieval.bisect_fraction(spark.sql(_MIX, px=views.pixels(spark, sf)), 50)
    return rows.select("event_id", rd("p_50", 6).alias("p"), rd("t_50", 2).alias("t"))


def _start_sql(name: str, p: str, t: str) -> str:
    return f"select '{name}' start, event_id, {p} p, {t} t, bt14_bkg_corr tb, r7_diff r7, r14_diff r14, b7, bl, {_K14} from dz join root using (region, scene, i, j)"


_K14 = ", ".join(f"{n}_{b}" for b in (7, 14) for n in ("fk1", "fk2", "bc1", "bc2"))
_KEPT = f"start, event_id, tb, r7, r14, b7, bl, {_K14}"
#: Each start of the refinement: from the bisection, far from the root, outside the domain, and where the two bands cannot be told apart.
_STARTS = {"bisected": ("root.p", "root.t"), "far": ("5e-1", "2e3"), "outside": ("2e0", "6e2"), "background": ("1e-2", "bt14_bkg_corr")}


def _worst(p: str, t: str) -> str:
    off = [f"abs({p} * {lum(b, t)} + (1 - {p}) * {cold} - {seen}) / greatest(abs({seen}), 1)" for b, cold, seen in (("7", "b7", "r7"), ("14", "bl", "r14"))]
    return f"greatest({off[0]}, {off[1]})"


def _slope_sql(b: str) -> str:
    x = f"(fk2_{b} / (t * bc2_{b} + bc1_{b}))"
    return f"fk1_{b} * fk2_{b} * bc2_{b} * exp({x}) / (pow(t * bc2_{b} + bc1_{b}, 2) * pow(exp({x}) - 1, 2))"


# One row a start and step; a step is tried at nine lengths and the longest that helps is taken.
_NEWTON = f"""
    , newton as (
      select {_KEPT}, 0 step, p, t, case when p between 1e-6 and 1 and t > 0 and tb > 0 and r7 > 0 and r14 > 0 then 'moving' else 'failed' end state
      from ({" union all ".join(_start_sql(name, p, t) for name, (p, t) in _STARTS.items())})
      union all
      select {_KEPT}, step + 1, case when worst > 1e-6 then coalesce(pick.p, p) else p end, case when worst > 1e-6 then coalesce(pick.t, t) else t end,
        case when worst <= 1e-6 then 'converged' when pick is null then 'failed' else 'moving' end
      from (select *, list_filter(list_transform(range(9), lambda h: {{'p': p - dp / pow(2, h), 't': t - dt / pow(2, h)}}),
              lambda s: abs(det) >= 1e-15 and s.p between 1e-6 and 1 and s.t > 0 and {_worst('s.p', 's.t')} < worst)[1] pick
        from (select *, (d * f7 - b * f14) / nullif(det, 0) dp, (a * f14 - c * f7) / nullif(det, 0) dt
          from (select *, a * d - b * c det from (select * replace (a / size as a, b / size as b, c / size as c, d / size as d, f7 / size as f7, f14 / size as f14)
            from (select *, greatest(abs(a), abs(b), abs(c), abs(d)) size
              from (select *, {_worst('p', 't')} worst, {lum('7', 't')} - b7 a, p * {_slope_sql('7')} b, {lum('14', 't')} - bl c, p * {_slope_sql('14')} d,
                  p * {lum('7', 't')} + (1 - p) * b7 - r7 f7, p * {lum('14', 't')} + (1 - p) * bl - r14 f14
                from newton where state = 'moving' and step < 50)))))))
    select start, event_id, converged, case when converged then round(p + 1.7e-9, 5) + 0e0 end p, case when converged then round(t + 1.7e-9, 1) + 0e0 end t, case when not converged then 6 end fail_char
    from (select start, event_id, arg_max(state, step) = 'converged' converged, arg_max_null(p, step) p, arg_max_null(t, step) t from newton group by all)
"""


@add("c3_newton", _mix_sql(15, _NEWTON))
def _(spark, sf):
    rows = settle(retrieval.bisect_fraction(spark.sql(_MIX, px=views.pixels(spark, sf)), 15))
    starts = {"bisected": (F.col("p_15"), F.col("t_15")), "far": (F.lit(0.5), F.lit(2000.0)), "outside": (F.lit(2.0), F.lit(600.0)), "background": (F.lit(0.01), F.col("bt14_bkg_corr"))}
    each = F.inline(F.array(*(F.struct(F.lit(n).alias("start"), p.cast("double").alias("sp"), t.cast("double").alias("st")) for n, (p, t) in starts.items())))
    found = newton.refined(rows.select("*", each), F.col("sp"), F.col("st"))
    solved = F.col("newton.converged")
    return found.select(
        "start", "event_id", solved.alias("converged"), F.when(solved, rd("newton.p", 5)).alias("p"), F.when(solved, rd("newton.t", 1)).alias("t"),
        F.when(~solved, 6).alias("fail_char"),
    )


@add("c4_retrieval_classes", on_states("ret1", "select fail_char, good valid, count(*) n from ret1 group by all"))
def _(spark, sf):
    rows = settle(corrections.correct(classified(spark, sf), views.lut(spark))).where("path = 'open'")
    rows = settle(retrieval.retrieve(rows))
    return rows.groupBy("fail_char", F.col("retrieval_valid").alias("valid")).agg(F.count("*").alias("n"))


@add("c5_radiative_power", on_states("ret3", f"select event_id, {srds('frp', 2)} from ret3 where kept"))
def _(spark, sf):
    return retrieved(spark, sf).where("path = 'open'").select("event_id", *rds("frp", 2))


# Part II --------------------------------------------------------------------------------------------------------------
_P1_STATES = "p1 as (select *, 10 p1_stage from thr)"


def _p2_sql(step: str, body: str) -> str:
    from emberframe.checks import oracle

    after = [c for c in oracle.AFTER]
    names = [n for n, _ in after]
    chain = [("px", views.pixel_sql("//")), ("states", _STATES.format(px="px")), ("bkg", _STATE_RADS.format(states="states")),
             *[c for c in oracle.STEPS if c[0] in ("thr0", "thr")], ("p1", "select * from thr"), *after[names.index("p2a"):]]
    out = []
    for name, sql in chain:
        out.append(f"{name} as materialized ({sql})")
        if name == step:
            break
    return f"with {', '.join(out)} {body}"


def part_two(spark, sf, policy="atbd"):
    return confirm.confirm(thresholds.contextual_thresholds(states(spark, sf)), policy)


@add("q1_elimination", _p2_sql("p2b", "select event_id, elim_reason from p2b"))
def _(spark, sf):
    return confirm.eliminate(thresholds.contextual_thresholds(states(spark, sf))).select("event_id", "elim_reason")


@add("q2_glint_edge", _p2_sql("p2b", "select event_id, flag0 <> fail_char glint_edge from p2b"))
def _(spark, sf):
    return part_two(spark, sf).select("event_id", "glint_edge")


@add("q3_fog_edge", _p2_sql("p2c", """
    select event_id, flag0 >= 9 and d20 + 5 - (bt7_bkg - bt14_bkg) < 15e-1 and bt7 - bt7_bkg <= 4 fog_edge from p2c"""))
def _(spark, sf):
    return part_two(spark, sf).select("event_id", "fog_edge")


@add("q4_base_category", _p2_sql("p2d", "select event_id, base_code from p2d"))
def _(spark, sf):
    return part_two(spark, sf).select("event_id", "base_code")


@add("q5_confidence_upgrade", _p2_sql("p2f", f"select event_id, upgraded, flag, category, {srds('thr1_high thr2_high thr1_medium thr2_medium')} from p2f"))
def _(spark, sf):
    return part_two(spark, sf).select("event_id", "upgraded", "flag", "category", *rds("thr1_high thr2_high thr1_medium thr2_medium"))


@add("q6_detection_policy", _p2_sql("p2f", """
    select event_id, case when category = 12 then 'cloud_contaminated' when category = 15 and bt7 - bt7_bkg < 6 then 'low_prob_delta_bt7_lt_6K' end policy_rejected
    from p2f"""))
def _(spark, sf):
    return part_two(spark, sf, "conservative").select("event_id", "policy_rejected")


@add("q7_area_sentinel", _p2_sql("fin0", f"select event_id, {srds('final_area')} from fin0"))
def _(spark, sf):
    return part_two(spark, sf).select("event_id", *rds("final_area"))


@add("q8_power_rule", _p2_sql("fin0", f"select event_id, {srds('final_frp')} from fin0"))
def _(spark, sf):
    return part_two(spark, sf).select("event_id", *rds("final_frp"))


@add("q9_mask_write_back", upto("mask", "select region, scene, i, j, p1_code, final_code from mask"))
def _(spark, sf):
    return detect.scene_masks(views.scene_pixels(spark, sf), views.lut(spark)).select(*IJ, "p1_code", "final_code")


@add("q10_category_tally", upto("mask", f"""
    select case when final_code >= 30 then final_code - 20 else final_code end base_code, count(*) n, count(*) filter (where final_code >= 30) n_filtered,
      {srd('median(final_frp) filter (where final_frp > 0)', 2)} median_frp, {srd('max(final_frp) filter (where final_frp > 0)', 2)} max_frp
    from mask where confirmed group by 1"""))
def _(spark, sf):
    from emberframe.operators.audit import category_tally

    return category_tally(trace(spark, sf)).select("base_code", "n", "n_filtered", *rds("median_frp max_frp", 2))


@add("q11_quality_flags", upto("mask", """
    select case when final_code between 10 and 35 then 0 when final_code = 100 then 1 when final_code >= 200 then 2
      when final_code in (0, 40, 50, 60, 150, 151, 152, 153) then 3 when final_code in (120, 121, 123, 124, 125, 126, 127, 160) then 4 else 5 end qa,
      count(*) n from mask group by 1"""))
def _(spark, sf):
    from emberframe.operators.audit import quality_flags

    return quality_flags(trace(spark, sf)).groupBy("qa").agg(F.count("*").alias("n"))


@add("q12_part_two_trace", _p2_sql("fin0", f"""
    select event_id, fail_char, elim_reason, flag0 <> fail_char glint_edge, flag, base_code, upgraded, category, confirmed, pass_along,
      {srd('bt7 - bt7_bkg')} d7, {srds('p2_std_reflb')} from fin0"""))
def _(spark, sf):
    return part_two(spark, sf).select("event_id", "fail_char", "elim_reason", "glint_edge", "flag", "base_code", "upgraded", "category", "confirmed",
                                      "pass_along", rd(F.col("bt7") - F.col("bt7_bkg")).alias("d7"), *rds("p2_std_reflb"))


@add("detect_fires", upto("fin", f"""
    select region, scene, i, j, final_code, flag, temporally_filtered, {srds('bt7 bt7_bkg fire_temp final_area final_frp', 2)} from fin where confirmed"""))
def _(spark, sf):
    found = detect.detections(views.scene_pixels(spark, sf), views.lut(spark)).where("confirmed")
    return found.select(*IJ, "final_code", "flag", "temporally_filtered", *rds("bt7 bt7_bkg fire_temp final_area final_frp", 2))
