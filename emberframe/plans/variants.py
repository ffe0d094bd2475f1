"""The detector over one-factor variants of its input, each step once for all variants that it is the same for.

Neighbours and backgrounds are found once a sight, gates and classification once a class, and only survivors that go on are
corrected, confirmed and filtered for each variant (`scenario.families`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberframe.operators import background, gates, scenario, thresholds
from emberframe.plans import detect
from emberframe.session import cut_lineage

PIXEL = ("base_region", "base_scene", "i", "j", "ref_code")
MASK = ("variant", *PIXEL, "candidate", "final_code")
# What the background reads of any pixel, and what steps after the gates read of those that get so far.
SEEN = ("land", "bt7", "bt14e", "vis", "refl", "is_day", "cos_sza", "albedo")
CARRIED = (
    "rad7", "rad14e", "use_ch13", "refl_m2", "refl_p2", "lza", "tpw", "tpw_climatology", "use_lut", "emiss7", "emiss14", "area_km2",
    *(f"{name}_{band}" for band in (7, 13, 14) for name in ("fk1", "fk2", "bc1", "bc2")),
)


def _judged(px: DataFrame, name: str, variant: str) -> DataFrame:
    """Column `name`: what the gates say with the variant's inputs. The pixel keeps its own."""
    changed = scenario.changes(variant, scenario.GATED)
    own = {f"_own_{c}": F.col(c) for c in changed}
    px = gates.judge(px.withColumns(own).withColumns(changed) if changed else px)
    px = px.withColumn(name, F.struct(*gates.OUTCOME)).drop(*gates.OUTCOME)
    return px.withColumns({c: F.col(f"_own_{c}") for c in changed}).drop(*own) if changed else px


def gated_classes(px: DataFrame, families: dict[str, dict[str, list[str]]]) -> DataFrame:
    """Each pixel once a sight; `runs` are the outcomes of its classes, `survivor` marks one that survives in any of them.

    Pixels are shuffled by scan line before they are repeated. Only survivors keep the columns of later steps.
    """
    px = scenario.with_variants(px.repartition(*gates.SCAN_LINE), tuple(families), scenario.EARLY)
    px = gates.scan_neighbours(detect.prepared(px), ("base_region", "base_scene", "i", "variant"))
    runs = F
    for sight, classes in families.items():
        for name in classes:
            px = _judged(px, f"_gates_{name}", name)
        outcomes = [F.struct(F.lit(name).alias("class"), *[F.col(f"_gates_{name}.{c}") for c in gates.OUTCOME]) for name in classes]
        runs = runs.when(F.col("variant") == sight, F.array(*outcomes))
    px = px.withColumn("runs", runs).withColumn("survivor", F.array_contains("runs.survivor", True))
    return px.select("region", "scene", "scene_epoch", *PIXEL, *SEEN, *[F.when(F.col("survivor"), F.col(c)).alias(c) for c in CARRIED], "runs", "survivor")


def classified_classes(gated: DataFrame) -> DataFrame:
    """Survivors of each class with code and path. Those that end there keep no more than that."""
    found = thresholds.contextual_thresholds(background.choose_approach(background.expanding_background(gated)))
    found = found.select("*", F.inline("runs")).drop("runs").where("survivor")
    found = thresholds.classify_survivors(found.drop("region", "scene", "survivor"))
    short, going_on = ("class", *PIXEL, "code", "path"), F.col("path").isin(*detect.GOING_ON)
    return found.select(*short, *[F.when(going_on, F.col(c)).alias(c) for c in found.columns if c not in short])


def each_variant(rows: DataFrame, families: dict[str, dict[str, list[str]]]) -> DataFrame:
    """Rows of classes once for each variant, with its inputs for the steps to come."""
    own = F
    for classes in families.values():
        for name, names in classes.items():
            own = own.when(F.col("class") == name, F.array(*[F.lit(n) for n in names]))
    rows = rows.withColumn("variant", F.explode(own)).drop("class")
    names = [n for classes in families.values() for group in classes.values() for n in group]
    left = [c for c in (*scenario.GATED, *scenario.LATE) if c in rows.columns]
    return scenario.own_scenes(scenario.replaced(rows, names, left))


def variant_masks(px: DataFrame, lut: DataFrame, names: Sequence[str] = scenario.VARIANTS) -> DataFrame:
    """Every pixel once per variant, with its final code and whether it is a candidate: `detect.full_trace` of `scenario.with_variants`."""
    families = scenario.families(names)
    gated = cut_lineage(gated_classes(px, families))
    found = cut_lineage(classified_classes(gated))
    stopped = each_variant(gated.select(*PIXEL, F.inline("runs")), families)
    rows = each_variant(found, families)
    return detect.whole_trace(stopped, rows, detect.traced(rows, lut)).select(*MASK)
