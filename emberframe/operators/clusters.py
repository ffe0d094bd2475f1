"""Fire clusters: connected components of fire pixels (8 neighbours), their centroids, and matches of two masks' clusters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberframe.session import cut_lineage

SCENE = ("region", "scene")
AHEAD = ((0, 1), (1, -1), (1, 0), (1, 1))


def tile_components(i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For distinct pixels of one tile, sorted by (i, j), the position of the first pixel of each one's component."""
    wide = int(j.max() - j.min()) + 3  # a column of air on both sides, so no row runs into the next
    place = (i - i.min()) * wide + (j - j.min()) + 1
    left, right = [], []
    for di, dj in AHEAD:
        at = np.searchsorted(place, place + di * wide + dj)
        found = np.flatnonzero(place[np.minimum(at, len(place) - 1)] == place + di * wide + dj)
        left.append(found)
        right.append(at[found])
    a, b = np.concatenate(left), np.concatenate(right)
    label = np.arange(len(place))
    while True:
        low, new = np.minimum(label[a], label[b]), label.copy()
        for end in (a, b):
            np.minimum.at(new, end, low)
            np.minimum.at(new, label[end], low)
        while not np.array_equal(hop := new[new], new):
            new = hop
        if np.array_equal(new, label):
            return label
        label = new


def labelled_tiles(fires: DataFrame, width: int, tile: int) -> DataFrame:
    """(region, scene, i, j, label) where label is the smallest pixel number of the pixel's component within its tile."""
    kinds = {f.name: f.dataType.simpleString() for f in fires.schema}
    pixels = fires.select(*SCENE, F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j")).distinct()

    def label(part: pa.Table) -> pa.Table:
        part = part.sort_by([("i", "ascending"), ("j", "ascending")])
        i, j = part.column("i").to_numpy(), part.column("j").to_numpy()
        first = tile_components(i, j)
        return part.select([*SCENE, "i", "j"]).append_column("label", pa.array((i * width + j)[first]))

    tiles = pixels.groupBy(*SCENE, F.floor(F.col("i") / tile).alias("ti"), F.floor(F.col("j") / tile).alias("tj"))
    return tiles.applyInArrow(label, f"region {kinds['region']}, scene {kinds['scene']}, i long, j long, label long")


def merged_labels(links: DataFrame, max_rounds: int) -> DataFrame:
    """(region, scene, id, label): for labels of a link table (region, scene, a, b), but for the smallest ones, the smallest reachable.

    Star contraction: in each round the larger neighbours of a label, then the smaller ones, are linked to the smallest instead, until
    every label has one link to its root. Links never grow in number, and rounds grow with the logarithm of a chain's length.
    Each round is a table in the shared folder; only two sums reach the driver.
    """
    pairs, seen = cut_lineage(links.where("a <> b").select(*SCENE, F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()), None
    for _ in range(max_rounds):
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64(*SCENE, "u", "v") % 1_000_003)).first()
        if state == seen:
            return pairs.select(*SCENE, F.col("u").alias("id"), F.col("v").alias("label"))
        seen = state
        both = pairs.union(pairs.select(*SCENE, F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy(*SCENE, "u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        above = both.where("v > u").join(lowest, [*SCENE, "u"]).select(*SCENE, F.col("v").alias("u"), F.col("m").alias("v"))
        large = above.union(lowest.where("m < u").select(*SCENE, "u", F.col("m").alias("v"))).distinct()
        below = large.groupBy(*SCENE, "u").agg(F.min("v").alias("m"))
        under = large.join(below, [*SCENE, "u"]).select(*SCENE, F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        pairs = cut_lineage(under.union(below.select(*SCENE, "u", F.col("m").alias("v"))).distinct())
    raise RuntimeError("clusters did not settle; raise max_rounds")


def fire_clusters(fires: DataFrame, width: int, tile: int = 256, max_rounds: int = 64) -> DataFrame:
    """(region, scene, i, j, label): `label` is the smallest pixel number i * width + j of the cluster.

    Components are found inside tiles, one group of bounded size each; then only labels that touch across a tile's border are merged
    in rounds, so the rounds hold border labels and not pixels. A mask without fires gives no rows.
    """
    pixels = cut_lineage(labelled_tiles(fires, width, tile))
    tile_of = lambda c: F.floor(F.col(c) / tile)
    rim = pixels.where(" or ".join(f"pmod({c}, {tile}) in (0, {tile - 1})" for c in "ij")).withColumns({"ti": tile_of("i"), "tj": tile_of("j")})
    steps = F.array(*[F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj")) for a, b in AHEAD])
    ahead = rim.select(*SCENE, F.col("label").alias("a"), "ti", "tj", "i", "j", F.inline(steps))
    ahead = ahead.select(*SCENE, "a", F.col("ti").alias("_ti"), F.col("tj").alias("_tj"), (F.col("i") + F.col("di")).alias("i"), (F.col("j") + F.col("dj")).alias("j"))
    across = ahead.join(rim.withColumnRenamed("label", "b"), [*SCENE, "i", "j"]).where("ti <> _ti or tj <> _tj")
    whole = merged_labels(across.select(*SCENE, "a", "b").distinct(), max_rounds).select(*SCENE, F.col("id").alias("label"), F.col("label").alias("_whole"))
    return pixels.join(whole, [*SCENE, "label"], "left").select(*SCENE, "i", "j", F.coalesce("_whole", "label").alias("label"))


def centroids(clusters: DataFrame) -> DataFrame:
    return clusters.groupBy(*SCENE, "label").agg(F.count("*").alias("n"), F.avg("i").alias("ci"), F.avg("j").alias("cj"))


def match_clusters(reference: DataFrame, predicted: DataFrame, share: float = 0.0) -> DataFrame:
    """(region, scene, label, n, shared, other, distance) of every reference cluster.

    `other` is the predicted cluster that shares most pixels with it, the smaller label on a tie, and `distance` that of the two
    centroids in pixels; both are NULL where less than `share` of the cluster, or nothing, is shared.
    """
    ref, pred = reference.withColumnRenamed("label", "ref"), predicted.withColumnRenamed("label", "pred")
    both = ref.join(pred, [*SCENE, "i", "j"]).groupBy(*SCENE, "ref", "pred").agg(F.count("*").alias("shared"))
    best = both.groupBy(*SCENE, F.col("ref").alias("label")).agg(F.max_by(F.struct("shared", F.col("pred").alias("other")), F.struct("shared", -F.col("pred"))).alias("_best")).select(*SCENE, "label", "_best.*")
    of_other = centroids(predicted).select(*SCENE, F.col("label").alias("other"), F.col("ci").alias("_ci"), F.col("cj").alias("_cj"))
    rows = centroids(reference).join(best, [*SCENE, "label"], "left").join(of_other, [*SCENE, "other"], "left")
    enough = F.col("shared") >= F.lit(share) * F.col("n")
    away = F.sqrt(F.pow(F.col("ci") - F.col("_ci"), 2) + F.pow(F.col("cj") - F.col("_cj"), 2))
    return rows.select(*SCENE, "label", "n", F.coalesce("shared", F.lit(0)).alias("shared"), F.when(enough, F.col("other")).alias("other"), F.when(enough, away).alias("distance"))


def cluster_scores(reference: DataFrame, predicted: DataFrame, share: float = 0.0) -> DataFrame:
    """Per scene: reference clusters, those hit, the rate, predicted clusters, those that share no pixel with a reference, mean distance of hits.

    A scene without reference clusters has rate NULL, one without hits distance NULL.
    """
    found = match_clusters(reference, predicted, share).groupBy(*SCENE).agg(F.count("*").alias("n_ref"), F.count("other").alias("n_hit"), F.avg("distance").alias("distance"))
    true = predicted.join(reference.select(*SCENE, "i", "j"), [*SCENE, "i", "j"]).select(*SCENE, "label").distinct().withColumn("_true", F.lit(1))
    of_pred = predicted.select(*SCENE, "label").distinct().join(true, [*SCENE, "label"], "left").groupBy(*SCENE).agg(F.count("*").alias("n_pred"), (F.count("*") - F.count("_true")).alias("n_false"))
    rows = found.join(of_pred, list(SCENE), "full")
    count = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select(*SCENE, *map(count, ("n_ref", "n_hit", "n_pred", "n_false")), (F.col("n_hit") / F.col("n_ref")).alias("hit_rate"), "distance")
