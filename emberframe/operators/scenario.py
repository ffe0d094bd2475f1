"""One-factor variants of the detector's input, run as one job with the variant as part of the scene key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberframe.codes import BASE_FIRE_CODES
from emberframe.functions.nulls import ratio
from emberframe.functions.order import medians
from emberframe.operators.audit import COUNTS, base_code, count_columns, is_fire, scores
from emberframe.session import cut_lineage

BASELINE = "baseline"

# Variant -> the input column it replaces and its new value.
_CHANGES: dict[str, dict[str, object]] = {
    BASELINE: {},
    "tpw_climatology": {"tpw": lambda: F.col("tpw_climatology")},
    "tpw_25": {"tpw": lambda: F.lit(25.0)},
    "tpw_minus_10": {"tpw": lambda: F.greatest(F.col("tpw") - 10.0, F.lit(0.0))},
    "tpw_plus_10": {"tpw": lambda: F.col("tpw") + 10.0},
    "neutral_lut": {"use_lut": lambda: F.lit(False)},
    "emissivity_one": {"emiss7": lambda: F.lit(1.0), "emiss14": lambda: F.lit(1.0)},
    "emissivity_constant": {"emiss7": lambda: F.lit(0.95), "emiss14": lambda: F.lit(0.97)},
    "no_band_2": {"refl2": lambda: F.lit(None).cast("double")},
    "no_band_15": {"bt15": lambda: F.lit(None).cast("double")},
    "forced_hybrid": {"fpt": lambda: F.lit(91.0)},
    "no_quality": {"dqf": lambda: F.lit(None).cast("int")},
}
VARIANTS = tuple(_CHANGES)

# Inputs by the first step that reads them: the corrections, the gates' own conditions, or (all others) neighbours and backgrounds.
LATE = ("tpw", "use_lut", "dqf")
GATED = ("emiss7", "emiss14", "bt15")
EARLY = tuple(sorted({c for changes in _CHANGES.values() for c in changes} - {*LATE, *GATED}))
ALL = (*EARLY, *GATED, *LATE)


def changes(name: str, columns: Sequence[str] = ALL) -> dict[str, Column]:
    """What a variant replaces among the columns."""
    return {c: value() for c, value in _CHANGES[name].items() if c in columns}


def families(names: Sequence[str]) -> dict[str, dict[str, list[str]]]:
    """The variants by what they replace among EARLY columns, and within such a sight by what they replace among GATED ones.

    Sights and the classes within go by the name of their first variant. All of a sight have the same neighbours and backgrounds, all
    of a class also the same gates.
    """
    same = lambda name, columns: str(sorted((c, str(v)) for c, v in changes(name, columns).items()))
    sights: dict[str, str] = {}
    classes: dict[tuple[str, str], str] = {}
    found: dict[str, dict[str, list[str]]] = {}
    for name in names:
        sight = sights.setdefault(same(name, EARLY), name)
        own = classes.setdefault((sight, same(name, GATED)), name)
        found.setdefault(sight, {}).setdefault(own, []).append(name)
    return found


def replaced(px: DataFrame, names: Sequence[str], columns: Sequence[str] = ALL) -> DataFrame:
    """The rows with what their `variant` replaces among the columns."""
    changed: dict[str, Column] = {}
    for name in names:
        for column, value in changes(name, columns).items():
            changed[column] = F.when(F.col("variant") == name, value).otherwise(changed.get(column, F.col(column)))
    return px.withColumns(changed) if changed else px


def own_scenes(px: DataFrame) -> DataFrame:
    """`region` and `scene` of a row's variant, so that windows, tiles and histories of different variants never mix."""
    return px.withColumns({"scene": F.concat_ws("/", F.col("base_scene").cast("string"), "variant"), "region": F.concat_ws("/", "base_region", "variant")})


def with_variants(px: DataFrame, names: Sequence[str] = VARIANTS, columns: Sequence[str] = ALL) -> DataFrame:
    """Each pixel once per variant, with that variant's inputs. `scene` becomes variant-specific, so windows and tiles of
    different variants never mix; `base_scene` keeps the original."""
    defaults = {"use_lut": F.lit(True), "dqf": F.lit(0), "tpw_climatology": F.lit(40.0)}
    px = px.withColumns({n: v for n, v in defaults.items() if n not in px.columns})
    px = replaced(px.withColumn("variant", F.explode(F.array(*[F.lit(n) for n in names]))), names, columns)
    return own_scenes(px.withColumns({"base_region": F.col("region"), "base_scene": F.col("scene")}))


def neutral_lut(lut: DataFrame) -> DataFrame:
    """Transmittance 1 and offset 0 with the same bins."""
    return lut.withColumns({
        "trans_4um": F.lit(1.0), "trans_11um": F.lit(1.0), "offset_4um": F.lit(0.0), "offset_11um": F.lit(0.0),
    })


def variant_scores(px: DataFrame, by: tuple[str, ...] = ("variant",)) -> DataFrame:
    """Scores and counts of candidates and of each base category per variant."""
    ref, pred = is_fire(F.col("ref_code")), is_fire(F.col("final_code"))
    categories = [F.count_if(base_code(F.col("final_code")) == c).alias(f"n_{c}") for c in BASE_FIRE_CODES]
    return scores(px.groupBy(*by).agg(F.count_if("candidate").alias("n_candidates"), *categories, *count_columns(ref, pred)))


def against_baseline(px: DataFrame) -> DataFrame:
    """Decisions each variant changed. One row per pixel carries all its variants, so nothing is joined to itself.

    Where no variant, the baseline included, sees a fire, no decision differs: only the other pixels' rows are gathered.
    """
    keys, pred = ("base_region", "base_scene", "i", "j"), is_fire(F.col("final_code"))
    names = px.where(F.col("variant") != BASELINE).select("variant").distinct()
    # keys may be null, so they travel in a struct
    hot = cut_lineage(px.where(pred).select(F.struct(*keys).alias("_pixel")).distinct())
    rows = px.withColumn("_pixel", F.struct(*keys)).join(hot, "_pixel", "left_semi")
    wide = rows.groupBy("_pixel").agg(
        F.max(F.when(F.col("variant") == BASELINE, pred)).alias("base"),
        F.max(is_fire(F.col("ref_code"))).alias("ref"),
        F.collect_list(F.when(F.col("variant") != BASELINE, F.struct("variant", pred.alias("pred")))).alias("others"),
    )
    rows = wide.select("base", "ref", F.inline("others"))
    flipped = F.col("pred") != F.col("base")
    counts = {
        "changed": flipped, "tp_lost": flipped & F.col("ref") & F.col("base"), "tp_gained": flipped & F.col("ref") & F.col("pred"),
        "fp_removed": flipped & ~F.col("ref") & F.col("base"), "fp_added": flipped & ~F.col("ref") & F.col("pred"),
    }
    found = rows.groupBy("variant").agg(*[F.count_if(c).alias(n) for n, c in counts.items()])
    return names.join(found, "variant", "left").select("variant", *[F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in counts])


def variant_rollup(px: DataFrame) -> DataFrame:
    """Per scene and variant, and the sum over scenes."""
    ref, pred = is_fire(F.col("ref_code")), is_fire(F.col("final_code"))
    table = px.groupingSets([["variant", "base_region", "base_scene"], ["variant"]], "variant", "base_region", "base_scene").agg(
        *count_columns(ref, pred), F.grouping("base_scene").alias("is_total")
    )
    return scores(table).select("variant", "base_region", "base_scene", "is_total", *COUNTS, "precision", "recall", "f1")


def ancillary_snapshot(px: DataFrame, columns: tuple[str, ...] = ("tpw", "emiss7")) -> DataFrame:
    """Smallest, median and largest value of each ancillary field per scene, and which optional bands are there."""
    table = px.groupBy("region", "scene").agg(
        *[f(F.col(c)).alias(f"{c}_{n}") for c in columns for n, f in (("min", F.min), ("max", F.max))],
        F.bool_or(F.col("refl2").isNotNull()).alias("has_band_2"), F.bool_or(F.col("bt15").isNotNull()).alias("has_band_15"),
        ratio(F.count("emiss14"), F.count("*")).alias("share_emiss14"),
    )
    found = medians(px, ["region", "scene"], columns).withColumnsRenamed({c: f"{c}_median" for c in columns})
    return table.join(found, ["region", "scene"], "left")
