"""Clusters over tiles against a plain flood fill, and their matches."""

import numpy as np
import pytest

from emberframe.operators import clusters


def flood(pixels):
    """Smallest pixel number of each pixel's 8-neighbour component."""
    left, out = set(pixels), {}
    for start in sorted(pixels):
        if start in out:
            continue
        stack = [start]
        while stack:
            i, j = stack.pop()
            if (i, j) in left:
                left.discard((i, j))
                out[i, j] = start[0] * 64 + start[1]
                stack += [(i + a, j + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (i + a, j + b) in left]
    return out


def masks(draw):
    """Random masks of several densities, a spiral through all tiles, a border line and one pixel."""
    out = [{(int(i), int(j)) for i, j in zip(*np.nonzero(draw.random((60, 64)) < p))} for p in (0.1, 0.35, 0.45)]
    out.append({(i, j) for i in range(0, 60, 2) for j in range(64)} | {(i, 63 if i % 4 == 1 else 0) for i in range(1, 58, 2)})
    return [*out, {(7, j) for j in range(64)} | {(8, 0), (9, 63)}, {(15, 16)}]


@pytest.mark.parametrize("tile", [1, 8, 256])
def test_clusters_over_tiles(spark, tile):
    wanted = {("r" + str(n % 2), n, i, j): label for n, mask in enumerate(masks(np.random.Generator(np.random.PCG64(41)))) for (i, j), label in flood(mask).items()}
    fires = spark.createDataFrame([(*k, 1.0) for k in wanted] * 2, "region string, scene int, i int, j int, value double")
    found = {(r.region, r.scene, r.i, r.j): r.label for r in clusters.fire_clusters(fires, 64, tile).collect()}
    assert found == wanted
    assert clusters.fire_clusters(fires.where("false"), 64, tile).count() == 0


def test_match_and_scores(spark):
    pixels = lambda rows: clusters.fire_clusters(spark.createDataFrame(rows, "region string, scene int, i int, j int"), 100)
    reference = pixels([("r", 0, 0, j) for j in range(4)] + [("r", 0, 10, 10), ("r", 0, 20, 20), ("r", 1, 5, 5)])
    predicted = pixels([("r", 0, 0, 3), ("r", 0, 0, 4), ("r", 0, 0, 0), ("r", 0, 10, 10), ("r", 0, 10, 11), ("r", 0, 40, 40), ("r", 2, 1, 1)])
    match = {(r.scene, r.label): (r.n, r.shared, r.other, r.distance) for r in clusters.match_clusters(reference, predicted).collect()}
    # two predicted clusters share a pixel each with the first: the smaller label is its match
    assert match == {(0, 0): (4, 1, 0, 1.5), (0, 1010): (1, 1, 1010, 0.5), (0, 2020): (1, 0, None, None), (1, 505): (1, 0, None, None)}
    half = {(r.scene, r.label): r.other for r in clusters.match_clusters(reference, predicted, 0.5).collect()}
    assert half == {(0, 0): None, (0, 1010): 1010, (0, 2020): None, (1, 505): None}
    scores = {r.scene: (r.n_ref, r.n_hit, r.n_pred, r.n_false, r.hit_rate, r.distance) for r in clusters.cluster_scores(reference, predicted).collect()}
    assert scores == {0: (3, 2, 4, 1, 2 / 3, 1.0), 1: (1, 0, 0, 0, 0.0, None), 2: (0, 0, 1, 1, None, None)}
