"""The detector written a second time, in plain SQL with brute-force joins, to check the Spark jobs against.

Nothing here is used by the engine. Each step is a common table expression; a check asks for the steps up to one.
"""

from __future__ import annotations

from emberframe.sources.views import pixel_sql


def lum(band: str, temp: str) -> str:
    return f"(case when {temp} > 0 then fk1_{band} / (exp(fk2_{band} / ({temp} * bc2_{band} + bc1_{band})) - 1) end)"


def tmp(band: str, rad: str) -> str:
    return f"(case when {rad} > 0 then (fk2_{band} / ln(1 + fk1_{band} / {rad}) - bc1_{band}) / bc2_{band} end)"


def _edge(name: str, step: int) -> str:
    if step < 0:
        return (f"case when row_number() over w <= {-step} then first_value({name}) over (w rows between unbounded preceding "
                f"and unbounded following) else lag({name}, {-step}) over w end")
    return (f"case when row_number() over (partition by region, scene, i order by j desc) <= {step} then last_value({name}) over "
            f"(w rows between unbounded preceding and unbounded following) else lead({name}, {step}) over w end")


STEPS: list[tuple[str, str]] = [
    ("px", pixel_sql("//")),
    ("bounds", "select region, min(i) i0, max(i) i1, min(j) j0, max(j) j1 from px group by region"),
    ("geo", "select distinct region, i, j, lat, lon from px"),
    ("corners", """
        select g.region, g.i, g.j, a.lat nw_lat, a.lon nw_lon, b.lat sw_lat, b.lon sw_lon, c.lat se_lat, c.lon se_lon,
          d.lat ne_lat, d.lon ne_lon
        from geo g join bounds k using (region)
        join geo a on a.region = g.region and a.i = greatest(g.i - 2, i0) and a.j = greatest(g.j - 2, j0)
        join geo b on b.region = g.region and b.i = least(g.i + 2, i1) and b.j = greatest(g.j - 2, j0)
        join geo c on c.region = g.region and c.i = least(g.i + 2, i1) and c.j = least(g.j + 2, j1)
        join geo d on d.region = g.region and d.i = greatest(g.i - 2, i0) and d.j = least(g.j + 2, j1)"""),
    ("areas", """
        select region, i, j, greatest((arc(nw_lat, nw_lon, sw_lat, sw_lon) + arc(ne_lat, ne_lon, se_lat, se_lon)) / 8e0
          * (arc(sw_lat, sw_lon, se_lat, se_lon) + arc(nw_lat, nw_lon, ne_lat, ne_lon)) / 8e0, 0e0) area_km2 from corners"""),
    ("lut", """
        select cast(id // 7 + 1 as int) tpw_bin, cast(id % 7 + 1 as int) zenith_bin,
          9e-1 - 3e-2 * (id // 7 + 1) - 1e-2 * (id % 7 + 1) trans_4um, 88e-2 - 3e-2 * (id // 7 + 1) - 1e-2 * (id % 7 + 1) trans_11um,
          1e-3 * (id // 7 + 1) offset_4um, 1e-2 * (id // 7 + 1) offset_11um from (select unnest(range(35)) id)"""),
    ("long1", f"""
        select *, coalesce(fpt > 90 and rad13 is not null and abs(rad7 - {lum('7', 'bt13')}) < abs(rad7 - {lum('7', 'bt14')}), false)
          use_ch13, eco_byte & 255 eco_code from px"""),
    ("long2", """
        select *, case when use_ch13 then bt13 else bt14 end bt14e, case when use_ch13 then rad13 else rad14 end rad14e,
          case when use_ch13 then fk1_13 else fk1_14 end fk1_l, case when use_ch13 then fk2_13 else fk2_14 end fk2_l,
          case when use_ch13 then bc1_13 else bc1_14 end bc1_l, case when use_ch13 then bc2_13 else bc2_14 end bc2_l from long1"""),
    ("prep", f"""
        select *, case when coalesce(rad7 < 0, false) or coalesce(rad14e < 0, false) then -9999e0
          else rad7 - {lum('7', 'bt14e')} end refl, sza between 0 and 85 is_day, cos(radians(sza)) cos_sza,
          255e0 * sqrt(case when refl2 < 0 then 0e0 else refl2 end) vis,
          case when sza between 0 and 85 and cos(radians(sza)) > 0 then refl2 / cos(radians(sza)) end albedo from long2"""),
    ("scan", f"""
        select *, {_edge('refl', -2)} refl_m2, {_edge('refl', 2)} refl_p2, {_edge('refl', -3)} refl_m3, {_edge('refl', 3)} refl_p3
        from prep window w as (partition by region, scene, i order by j)"""),
    ("gate0", """
        select *, case when not in_roi then 0 when bt7 is null then 40 when lza > 80 then 50 when sza < 10 or glint < 10 then 60
          when bt14e is null then 121 when bt7 > 411.86e0 + 5 then 123 when bt14e > 345 then 124 when bt7 < 200 then 126
          when bt14e < 200 then 127
          when emiss7 is null or emiss14 is null or emiss7 <= 0 or emiss7 > 1 or emiss14 <= 0 or emiss14 > 1 then 160
          when eco_code in (150, 151, 152, 153) then eco_code when rad7 < 0 or rad14e < 0 then 125
          when (bt7 > 273 or bt14e > 273) and abs(bt7 - bt14e) <= 2 then 100
          when bt7 - bt14e < 2 and (bt7 <= 273 or bt14e <= 273) then 201 end hard,
          case when bt14e < 270 then 200 when bt7 - bt14e < -4 then 205 when bt7 - bt14e > 20 and bt7 < 285 then 210
          when is_day and sza <= 70 and albedo > 38e-2 then 215 when bt15 <= 265 then 220 end cloud from scan"""),
    ("gate1", """
        select *, case when hard is null and cloud is null and (refl_m3 < 2e-1 or refl_p3 < 2e-1) then
          case when is_day and albedo >= 38e-2 and bt7 < 320 then 245 when not is_day and bt7 < 285 and bt7 >= 150 then 240 end
          end along from gate0"""),
    ("gated", """
        select *, coalesce(hard, cloud, along, 100) code,
          case when hard is null then case when along is null then 9 else 8 end when hard in (0, 40) then 0 when hard = 50 then 1
          when hard = 60 then 2 when hard in (121, 123, 124, 126, 127) then 3 when hard in (160, 150, 151, 152, 153) then 4
          when hard = 125 then 5 else 6 end stage,
          hard is null and cloud is not null is_cloudy, hard is null and along is null survivor,
          hard is null and along is null and coalesce(bt7 >= 41176e-2 or bt14e >= 3399e-1, false) sat_flag,
          land and bt7 is not null and bt14e is not null
            and bt7 <= 310 + case when is_day then 25 * cos_sza else 0 end and bt7 >= 270 and bt14e >= 270
            and not coalesce(is_day and (vis < 1 or albedo > 38e-2) and vis is not null and albedo is not null, false) valid
        from gate1"""),
    ("counts", "select s.region, s.scene, s.i, s.j, " + ", ".join(
        f"count(v.i) filter (where greatest(abs(v.i - s.i), abs(v.j - s.j)) <= {h}) n_{h}" for h in range(5, 56, 5)) + """
        from gated s left join gated v on v.region = s.region and v.scene = s.scene and v.valid and (v.i <> s.i or v.j <> s.j)
          and abs(v.i - s.i) <= 55 and abs(v.j - s.j) <= 55
        where s.survivor group by s.region, s.scene, s.i, s.j"""),
    ("levels", "select *, case " + " ".join(
        f"when n_{h} >= 2e-1 * {(2 * h + 1) ** 2} then {h}" for h in range(5, 56, 5)) + " end half_width from counts"),
    ("inside", """
        select l.region, l.scene, l.i, l.j, v.bt7, v.bt14e, v.bt7 - v.bt14e d, v.vis, v.refl
        from levels l join gated v on v.region = l.region and v.scene = l.scene and v.valid and (v.i <> l.i or v.j <> l.j)
          and abs(v.i - l.i) <= l.half_width and abs(v.j - l.j) <= l.half_width"""),
    ("stat", """
        select region, scene, i, j, count(*) n_valid, avg(bt7) t7_stat_mean, stddev_pop(bt7) t7_stat_std, avg(bt14e) t14_stat_mean,
          stddev_pop(bt14e) t14_stat_std, stddev_pop(d) diff_stat_std,
          coalesce(avg(refl) filter (where refl > -9998), -9999e0) reflb,
          coalesce(stddev_pop(refl) filter (where refl > -9998), 0e0) rad_diff_sigma from inside group by all"""),
    ("peak", """
        select region, scene, i, j, bin from (select region, scene, i, j, round_even(d, 0) bin, row_number() over (partition by region, scene, i, j
          order by count(*) desc, round_even(d, 0)) k from inside group by region, scene, i, j, round_even(d, 0)) where k = 1"""),
    ("hist", """
        select region, scene, i, j, count(*) n_hist, avg(bt7) t7_hist_mean, stddev_pop(bt7) t7_hist_std, avg(bt14e) t14_hist_mean,
          stddev_pop(bt14e) t14_hist_std, stddev_pop(d) diff_hist_std,
          case when count(vis) = count(*) then avg(vis) end vis_hist_mean,
          case when count(vis) = count(*) then stddev_pop(vis) end vis_hist_std
        from inside join peak using (region, scene, i, j) where abs(round_even(d, 0) - bin) <= 1 group by all"""),
    ("vpeak", """
        select region, scene, i, j, bin from (select region, scene, i, j, round_even(vis, 0) bin, row_number() over (partition by region, scene, i, j
          order by count(*) desc, round_even(vis, 0)) k from inside where vis is not null
          group by region, scene, i, j, round_even(vis, 0)) where k = 1"""),
    ("vhist", """
        select region, scene, i, j, avg(vis) vis_bin_mean, stddev_pop(vis) vis_bin_std from inside join vpeak using (region, scene, i, j)
        where abs(round_even(vis, 0) - bin) <= 1 group by all"""),
    ("bkg0", """
        select g.*, area_km2, half_width, n_valid, n_hist, t7_stat_mean, t7_stat_std, t14_stat_mean, t14_stat_std, diff_stat_std,
          t7_hist_mean, t7_hist_std, t14_hist_mean, t14_hist_std, diff_hist_std, vis_hist_mean, vis_hist_std, vis_bin_mean,
          vis_bin_std, reflb, rad_diff_sigma, half_width // 5 - 1 n_passes,
          case when half_width is not null then case when n_hist = n_valid or t7_stat_std <= t7_hist_std then 'stat' else 'hist' end
          end approach
        from gated g join levels using (region, scene, i, j) left join stat using (region, scene, i, j) left join hist using (region, scene, i, j)
        left join vhist using (region, scene, i, j) left join areas a on a.region = g.region and a.i = g.i and a.j = g.j"""),
    ("bkg", """
        select *, case approach when 'stat' then t7_stat_mean else t7_hist_mean end bt7_bkg,
          case approach when 'stat' then t14_stat_mean else t14_hist_mean end bt14_bkg,
          case approach when 'stat' then t7_stat_std else t7_hist_std end bt7_bkg_std,
          case approach when 'stat' then t14_stat_std else t14_hist_std end bt14_bkg_std,
          case approach when 'stat' then diff_stat_std else diff_hist_std end diff_std,
          case approach when 'stat' then vis_bin_mean else vis_hist_mean end vis_bkg from bkg0"""),
    ("thr0", """
        select *, case when diff_std is not null then least(4e0, 3 * diff_std) end std_7b14b,
          case when half_width is not null then greatest(4e0, least(1e1, 375e-2 * bt7_bkg_std + least(5e0, n_passes / 3e0))) end std_7b,
          case when half_width is not null then greatest(25e-2, least(1e0, 3 * rad_diff_sigma)) end std_reflb,
          case when half_width is not null then greatest(25e-1, least(1e1, 25e-1 * rad_diff_sigma + 5e-1 * least(5e0, n_passes / 3e0)))
          end std_reflb_max,
          case when is_day then pow(vis_bkg / 255e-1, 2) / (greatest(cos_sza, 1e-6) * 100) end albedo_bkg,
          315 + case when is_day then 5 * cos_sza else 0 end bt7_refl_thr from bkg"""),
    ("thr", """
        select *, not coalesce(refl - refl_m2 < std_reflb and refl - refl_p2 < std_reflb and bt7 < bt7_refl_thr, false) pass_along
        from thr0"""),
    ("cls", """
        select *, case when half_width is null then 'none'
          when sat_flag and (bt7 - bt14e < std_7b14b or bt7 - bt7_bkg < std_7b) then 'quick'
          when (refl < std_reflb and bt7 < 320) or bt7 - bt14e < 0 or bt7 - bt7_bkg < 0 then 'non_fire'
          when bt7 - bt14e < std_7b14b and (refl < std_reflb_max or pass_along) then 'flag_1'
          when bt7 - bt7_bkg < std_7b and (refl < std_reflb_max or pass_along) then 'flag_2' else 'open' end step0 from thr"""),
    ("cor0", """
        select *, (rad7 - offset_4um) / trans_4um r7_tpw, (rad14e - offset_11um) / trans_11um r14_tpw
        from (select *, cast(least(greatest(round_even(tpw / 10, 0), 1), 5) as int) tpw_bin,
          cast(least(greatest(round_even(lza / 10, 0), 1), 7) as int) zenith_bin from cls where step0 = 'open')
        join lut using (tpw_bin, zenith_bin)"""),
    ("cor1", f"""
        select *, {tmp('7', 'r7_tpw')} t7_tpw, {tmp('l', 'r14_tpw')} t14_tpw, r7_tpw / emiss7 r7_em, r14_tpw / emiss14 r14_em,
          ({lum('7', 'bt7_bkg')} - offset_4um) / trans_4um / emiss7 r7_bkg,
          ({lum('l', 'bt14_bkg')} - offset_11um) / trans_11um / emiss14 r14_bkg from cor0"""),
    ("cor2", f"select *, {tmp('l', 'r14_bkg')} bt14_bkg_corr, {tmp('7', 'r7_bkg')} bt7_bkg_corr from cor1"),
    ("cor3", f"select *, {lum('7', 'bt14_bkg_corr')} r7_from_14 from cor2"),
    ("cor4", """
        select *, case when is_day then (r7_em - greatest(0, r7_bkg - emiss7 * r7_from_14)) / emiss7 else r7_em end r7_solar from cor3"""),
    ("cor5", """
        select *, (r7_solar - 15e-2 * r7_from_14) / 85e-2 r7_diff, (r14_em - 3e-1 * r14_bkg) / 7e-1 r14_diff from cor4"""),
    ("cor6", f"select *, {tmp('7', 'r7_diff')} t7c, {tmp('l', 'r14_diff')} t14c from cor5"),
    ("cor", """
        select *, case when r7_tpw < 0 or r14_tpw < 0 or t7_tpw <= 0 or t14_tpw <= 0 then 14 when r7_bkg <= 0 or r14_bkg <= 0 then 15
          when r7_solar <= 0 or r7_diff <= 0 or r14_diff <= 0 or t7c <= 0 or t14c <= 0 or bt7_bkg_corr <= 0 or bt14_bkg_corr <= 0
          then 16 end failed_at,
          case when not sat_flag and (t14c < 285 or t7c < 285 + case when is_day then 15 * cos_sza else 0 end) then 3
          when t14c - bt14_bkg_corr < 25e-2 then case when (coalesce(albedo > 15e-2, false) or is_cloudy) and t7c - bt14_bkg_corr > 10
            then 10 else 4 end
          when t7c - bt14_bkg_corr < 2 then 5 when sat_flag then 7
          when is_day and (albedo >= 25e-2 or albedo - albedo_bkg > 7e-2) then 8 else -1 end fail_post from cor6"""),
    ("dz", f"""
        select *, {lum('7', 'bt14_bkg_corr')} b7, {lum('l', 'bt14_bkg_corr')} bl from cor
        where failed_at is null and not sat_flag and fail_post not in (3, 4, 5, 10)"""),
]

_DIFF = lambda p: (f"sign({tmp('7', f'((r7_diff - (1 - {p}) * b7) / {p})')} - {tmp('l', f'((r14_diff - (1 - {p}) * bl) / {p})')})")
_CARRY = "region, scene, i, j, r7_diff, r14_diff, b7, bl, fk1_7, fk2_7, bc1_7, bc2_7, fk1_l, fk2_l, bc1_l, bc2_l"


def bisection(steps: int) -> list[tuple[str, str]]:
    return [
        ("brk", f"select {_CARRY}, {_DIFF('1e-6')} s_lo, {_DIFF('1e0')} s_hi from dz"),
        ("bis", f"""
            select {_CARRY}, s_lo, 1e-6 lo, 1e0 hi, null::double p, 0 step, false done from brk where s_lo <> s_hi and s_lo <> 0 and s_hi <> 0
            union all
            select {_CARRY}, s_lo, case when s = s_lo then m else lo end, case when s = s_lo then hi else m end,
              case when s is null then null else m end, step + 1, s is null or s = 0
            from (select *, {_DIFF('m')} s from (select *, sqrt(lo * hi) m from bis where step < {steps} and not done))"""),
        ("root", f"""
            select region, scene, i, j, p, {tmp('7', '((r7_diff - (1 - p) * b7) / p)')} t from
              (select {_CARRY}, arg_max_null(p, step) p from bis group by all)"""),
    ]


AFTER: list[tuple[str, str]] = [
    ("ret", """
        select c.*, p, t, fail_post in (3, 4, 5, 10) skip, not sat_flag and fail_post not in (3, 4, 5, 10) tried
        from cor c left join root using (region, scene, i, j) where failed_at is null"""),
    ("ret1", """
        select *, case when not tried then fail_post when t is null then 6 when t < 400 then case when fail_post = 8 then 9 else 6 end
          else -1 end fail_char, tried and coalesce(t >= 400, false) good,
          case when not tried then case when sat_flag then 0e0 else -905e-2 end when t is null then -999e0 else t end ft from ret"""),
    ("ret2", """
        select *, not sat_flag and not good needs,
          (bt7 - bt7_bkg >= std_7b and bt14e - bt14_bkg >= -20) or (refl - reflb >= std_reflb_max and pass_along) lct from ret1"""),
    ("ret3", """
        select *, not needs or lct kept, case when needs then case when ft > 350 and ft <= 400 then -abs(ft) else -999e0 end else ft end
          fire_temp, case when needs or not tried then 0e0 else p end fire_frac,
          case when fail_char in (7, 9, 10) then -9e0 else area_km2 * 1e6 / 3e-3 * 567e-10 * (1e-5 / (39e-7 * 39e-7)) *
          (r7_diff - case when is_day then emiss7 * r7_from_14 else r7_bkg end) / 1e6 end frp from ret2"""),
    ("p1", """
        select g.*, c.approach, c.half_width, c.n_passes, c.n_valid, c.n_hist, c.area_km2, c.bt7_bkg, c.bt14_bkg, c.bt7_bkg_std,
          c.bt14_bkg_std, c.t7_stat_std, c.t7_hist_std, c.diff_std, c.reflb, c.rad_diff_sigma, c.albedo_bkg, c.std_7b14b, c.std_7b,
          c.std_reflb, c.std_reflb_max, coalesce(c.pass_along, false) pass_along, c.step0,
          case when c.step0 = 'none' then 170 when f.failed_at is not null then 180 else g.code end p1_code,
          case when not g.survivor then g.stage when c.step0 = 'none' then 9 when c.step0 = 'quick' then 22 when c.step0 = 'non_fire' then 11
            when c.step0 = 'flag_1' then 12 when c.step0 = 'flag_2' then 13 when f.failed_at is not null then f.failed_at
            when r.kept then 22 else 19 end p1_stage,
          case c.step0 when 'flag_1' then 1 when 'flag_2' then 2 when 'open' then
            coalesce(r.fail_char, case when g.sat_flag then 7 else -1 end)
            else case when g.sat_flag then 7 else -1 end end fail_char,
          coalesce(c.step0 = 'quick' or r.kept, false) candidate,
          case when c.step0 = 'quick' then case when g.sat_flag then 0e0 else -905e-2 end when r.kept then r.fire_temp end fire_temp,
          case when c.step0 = 'quick' then 0e0 when r.kept then r.fire_frac end fire_frac,
          case when c.step0 = 'quick' then 0e0 when r.kept then r.fire_frac * c.area_km2 end fire_area,
          case when c.step0 = 'quick' then -9e0 when r.kept then r.frp end frp,
          r.t7c bt7_corr, r.t14c bt14_corr, r.bt7_bkg_corr, r.bt14_bkg_corr, coalesce(r.skip, false) skip_retrieval,
          coalesce(r.good, false) retrieval_valid
        from gated g left join cls c using (region, scene, i, j) left join (select region, scene, i, j, failed_at from cor) f using (region, scene, i, j)
        left join ret3 r using (region, scene, i, j)"""),
    ("p2a", """
        select *, case when is_day then 20 * cos_sza else 0 end d20, greatest(25e-1, 25e-1 * rad_diff_sigma) p2_std_reflb
        from p1 where candidate"""),
    ("p2b", """
        select *, case when ok and bt7 - bt7_bkg < 2 then 'cond1'
          when ok and bt7 < 290 + d20 and bt7 - bt7_bkg < 10 and bt7 - bt14e < 25 then 'cond2'
          when ok and bt7 < 290 + d20 and bt7_bkg < 280 + d20 and n_passes >= 10 then 'cond3' end elim_reason,
          case when fail_char in (9, 10) and (coalesce(albedo, 0) > 25e-2 or coalesce(albedo, 0) - coalesce(albedo_bkg, 0) >= 1e-1)
            and bt7 < 2925e-1 + d20 then 11 else fail_char end flag0
        from (select *, coalesce(refl - reflb < p2_std_reflb, false) or pass_along ok from p2a)"""),
    ("p2c", """
        select *, case when flag0 >= 9 and d20 + 5 - (bt7_bkg - bt14_bkg) < 15e-1 and bt7 - bt7_bkg <= 4 then 11 else flag0 end flag1,
          least(5e0, n_passes / 3e0) grow, coalesce(refl - reflb >= std_reflb_max, false) or pass_along shine from p2b"""),
    ("p2d", """
        select *, case when fire_temp > 400 then 10 when sat_flag and fire_temp = 0 then 11 when flag1 in (9, 10) then 12 else 15 end base_code,
          greatest(7e0, 5 + grow + 2 * bt7_bkg_std) thr1_high, greatest(7e0, 5 + grow + bt7_bkg - bt14_bkg + 2 * diff_std) thr2_high,
          greatest(5e0, 3 + grow + 2 * bt7_bkg_std) thr1_medium, greatest(5e0, 3 + grow + bt7_bkg - bt14_bkg + 2 * diff_std) thr2_medium
        from p2c"""),
    ("p2e", """
        select *, case when flag1 in (3, 4, 6, 8) and fire_temp < 0 then
          case when shine and bt7 - bt7_bkg > thr1_high and bt7 - bt14e > thr2_high then 13
          when shine and bt7 - bt7_bkg > thr1_medium and bt7 - bt14e > thr2_medium then 14 else 15 end end upgraded from p2d"""),
    ("p2f", """
        select *, coalesce(upgraded, base_code) category, flag1 + case upgraded when 13 then 30 when 14 then 20 else 0 end flag,
          elim_reason is null confirmed from p2e"""),
    ("fin0", """
        select *, case when category <> 10 and fire_temp < 400 then -999e0 else fire_area end final_area,
          case when category in (11, 12, 15) then -9e0 else frp end final_frp from p2f"""),
    ("fin", """
        select *, case when confirmed then category + case when temporally_filtered then 20 else 0 end end final_code from
          (select a.*, a.confirmed and exists (select 1 from fin0 b where b.confirmed and b.region = a.region and abs(b.i - a.i) <= 1
            and abs(b.j - a.j) <= 1 and b.scene_epoch < a.scene_epoch and b.scene_epoch >= a.scene_epoch - 43200) temporally_filtered
          from fin0 a)"""),
    ("mask", """
        select p.*, coalesce(f.confirmed, false) confirmed, coalesce(f.final_code, p.p1_code) final_code,
          case when p.candidate then f.flag else p.fail_char end flag_out, f.elim_reason, f.category, f.upgraded, f.base_code,
          f.temporally_filtered, f.flag fin_flag, f.flag0, f.flag1, f.final_area, f.final_frp
        from p1 p left join fin f using (region, scene, i, j)"""),
]

_ARC = "6378137e-3 * acos(greatest(-1e0, least(1e0, sin(radians({0})) * sin(radians({2})) + cos(radians({0})) * cos(radians({2})) * cos(radians({3} - {1})))))"


def _expand_arc(sql: str) -> str:
    while "arc(" in sql:
        a = sql.index("arc(")
        b = sql.index(")", a)
        sql = sql[:a] + _ARC.format(*[x.strip() for x in sql[a + 4 : b].split(",")]).replace("acos(", "ACOS(") + sql[b + 1 :]
    return sql


def upto(step: str, body: str, steps: int = 50) -> str:
    """`body` after the steps that lead to `step`."""
    out = []
    for name, sql in [*STEPS, *bisection(steps), *AFTER]:
        plain = "" if name == "bis" else " materialized"
        out.append(f"{name} as{plain} ({_expand_arc(sql)})")
        if name == step:
            break
    return f"with recursive {', '.join(out)} {body}"
