"""Sub-pixel fire fraction and temperature, last-chance test, area and radiative power."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberframe import codes as k
from emberframe.functions.nulls import holds
from emberframe.functions.settle import settle
from emberframe.functions.radiometry import BandCoefficients, native_to_si, radiance_of, temperature_of
from emberframe.operators.corrections import long_coefficients
from emberframe.operators.newton import refined


def fire_radiance(total: Column, background: Column, p: Column) -> Column:
    return (total - (1 - p) * background) / p


def bisect_fraction(px: DataFrame, steps: int, where: Column | None = None) -> DataFrame:
    """Columns p_<steps>, t_<steps>: the fraction where both bands give one fire temperature, NULL when not bracketed.

    Logarithmic bisection on [1e-6, 1], folded over the steps inside the row. With 15 steps it is the published
    bisection; with 50 it reaches the root that a Newton refinement of the two-band system converges to, so one fold
    serves both and stays in the JVM.
    """
    seven, long = BandCoefficients.of(7), long_coefficients()
    where = F.lit(True) if where is None else where
    px = px.withColumns({"_b7": radiance_of(F.col("bt14_bkg_corr"), seven), "_b14": radiance_of(F.col("bt14_bkg_corr"), long)})

    def hot(p: Column) -> Column:
        return temperature_of(fire_radiance(F.col("r7_diff"), F.col("_b7"), p), seven)

    def sign(p: Column) -> Column:
        return F.signum(hot(p) - temperature_of(fire_radiance(F.col("r14_diff"), F.col("_b14"), p), long))

    px = px.withColumns({"_lo": sign(F.lit(k.P_LOW)), "_hi": sign(F.lit(k.P_HIGH))})

    def bind(value: Column, use) -> Column:
        """`use(value)` with the value computed once: a name inside an expression is a lambda over one element."""
        return F.element_at(F.transform(F.array(value), use), 1)

    def halve(state: Column, _: Column) -> Column:
        def moved(mid: Column, at: Column) -> Column:
            low_side = at == F.col("_lo")
            return F.struct(
                F.when(low_side, mid).otherwise(state["lo"]).alias("lo"), F.when(low_side, state["hi"]).otherwise(mid).alias("hi"),
                F.when(at.isNotNull(), mid).alias("p"), (at.isNull() | (at == 0)).alias("done"),
            )

        step = bind(F.sqrt(state["lo"] * state["hi"]), lambda mid: bind(sign(mid), lambda at: moved(mid, at)))
        return F.when(state["done"], state).otherwise(step)

    start = F.struct(
        F.lit(k.P_LOW).alias("lo"), F.lit(k.P_HIGH).alias("hi"), F.lit(k.P_LOW).alias("p"), F.lit(False).alias("done")
    )
    folded = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve)["p"]
    p = (
        F.when(~where | F.col("_lo").isNull() | F.col("_hi").isNull(), None)
        .when(F.col("_lo") == 0, k.P_LOW)
        .when(F.col("_hi") == 0, k.P_HIGH)
        .when(F.col("_lo") != F.col("_hi"), folded)
    )
    px = px.withColumn(f"p_{steps}", p)
    return px.withColumn(f"t_{steps}", hot(F.col(f"p_{steps}"))).drop("_b7", "_b14", "_lo", "_hi")


def retrieve(px: DataFrame, steps: int = k.REFINED_STEPS, newton: bool = False) -> DataFrame:
    """fire_temp, fire_frac, flag and validity after the retrieval of `open` pixels; the fold runs for no others.

    With `newton`, the published bisection gives the start of Newton's method, and a pixel that does not converge has no solution.
    """
    if newton:
        steps = k.BISECTION_STEPS
    c = F.col
    px = px.withColumn("_tried", (c("path") == "open") & ~c("skip_retrieval") & ~c("sat_flag"))
    px = bisect_fraction(px, steps, c("_tried"))
    if newton:
        px = refined(px, c(f"p_{steps}"), c(f"t_{steps}"), "_newton")
        px = px.withColumns({f"{n}_{steps}": F.when(c("_newton.converged"), c(f"_newton.{n}")) for n in ("p", "t")}).drop("_newton")
    p, t = c(f"p_{steps}"), c(f"t_{steps}")
    solved = holds(t > 0)
    cool = solved & holds(t < k.MIN_FIRE_TEMP)
    start = F.when(c("sat_flag"), 0.0).otherwise(k.INITIAL_FIRE_TEMP)
    return px.withColumns({
        "fire_temp": F.when(~c("_tried"), start).when(solved, t).otherwise(k.NOT_RETRIEVED),
        "fire_frac": F.when(~c("_tried"), 0.0).when(solved, p),
        "retrieval_valid": c("_tried") & solved & ~cool,
        "fail_char": F.when(~c("_tried"), c("fail_char"))
        .when(cool & (c("fail_char") == 8), 9).when(~solved | cool, 6).otherwise(-1),
    }).drop(f"p_{steps}", f"t_{steps}", "_tried")


def last_chance(px: DataFrame) -> DataFrame:
    """`open` pixels without a solution stay only with a warm or reflective contrast."""
    c = F.col
    needs = (c("path") == "open") & ~c("sat_flag") & ~c("retrieval_valid")
    warm = holds((c("bt7") - c("bt7_bkg") >= c("std_7b")) & (c("bt14e") - c("bt14_bkg") >= -20.0))
    shining = holds(c("refl") - c("reflb") >= c("std_reflb_max")) & c("pass_along")
    lukewarm = holds((c("fire_temp") > k.MAX_SURFACE_TEMP) & (c("fire_temp") <= k.MIN_FIRE_TEMP))
    px = px.withColumn("_needs", needs)
    return px.withColumns({
        "path": F.when(c("_needs") & ~(warm | shining), "stopped").otherwise(c("path")),
        "stage": F.when(c("_needs") & ~(warm | shining), 19).otherwise(c("stage")).cast("int"),
        "fire_temp": F.when(~c("_needs"), c("fire_temp"))
        .when(lukewarm, -F.abs(c("fire_temp"))).otherwise(k.NOT_RETRIEVED),
        "fire_frac": F.when(c("_needs"), 0.0).otherwise(F.coalesce(c("fire_frac"), F.lit(0.0))),
    }).drop("_needs")


def radiative_power(area_km2: Column, observed: Column, background: Column) -> Column:
    """Mid-infrared power in MW from native band-7 radiances."""
    excess = native_to_si(observed, k.WAVELENGTH_M[7]) - native_to_si(background, k.WAVELENGTH_M[7])
    return area_km2 * 1e6 / k.FRP_MIR * k.STEFAN_BOLTZMANN * excess / 1e6


def size_and_power(px: DataFrame) -> DataFrame:
    """Candidates with area and power: `open` pixels that are left, and `quick` ones, which have no retrieval."""
    c = F.col
    background = F.when(c("is_day"), c("emiss7") * c("r7_from_14")).otherwise(c("r7_bkg"))
    skipped = c("fail_char").isin(7, 9, 10) | (c("n_passes") > k.MAX_PASSES)
    bad_area = c("path").isin("open", "quick") & holds(c("area_km2") < 0)
    px = px.withColumns({
        "candidate": c("path").isin("open", "quick") & ~bad_area,
        "code": F.when(bad_area, 188).otherwise(c("code")).cast("int"),
        "stage": F.when(bad_area, 20).when(c("path").isin("open", "quick"), 22).otherwise(c("stage")).cast("int"),
    })
    power = F.when((c("path") == "quick") | skipped, k.FRP_SKIPPED).otherwise(
        radiative_power(c("area_km2"), c("r7_diff"), background)
    )
    found = lambda value: F.when(c("candidate"), value)
    px = px.withColumns({
        "fire_area": found(F.when(c("path") == "quick", 0.0).otherwise(c("fire_frac") * c("area_km2"))),
        "frp": found(power), "fire_temp": found(c("fire_temp")), "fire_frac": found(c("fire_frac")),
    })
    return settle(px)
