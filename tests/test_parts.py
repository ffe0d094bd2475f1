"""Many small scenes: they share tasks, and a scene comes in few files."""

from __future__ import annotations

from emberframe.session import new_path
from emberframe.sources import scenes

T0 = 1704067200


def test_small_scenes_share_partitions_and_large_ones_do_not(spark):
    rows = [("r", T0 + 600 * s, i, 0, float(s), float(i)) for s in range(60) for i in range(8)]
    px, root = spark.createDataFrame(rows, "region string, scene_epoch bigint, i int, j int, a double, b double"), new_path(spark, "store")
    scenes.write_bands(px.repartition(5), root, "p", {"A": ["a"], "B": ["b"]})
    assert scenes.announce(root, "1", ["p"], ["A", "B"]) == []
    found = scenes.read_scenes(spark, root, "a double, b double")
    assert 8 <= found.rdd.getNumPartitions() < 20  # 120 scenes and bands, each in one file though five tasks had its pixels
    assert all(len(part.files) == 1 for part in scenes.parts_of(root, ["1.json"]))
    whole = scenes.assemble(found, ["A", "B"])
    assert whole.exceptAll(px).count() == 0 and px.exceptAll(whole).count() == 0
    large = [scenes.ScenePart("r", s, "A", ("f",), scenes.LARGEST) for s in range(3)]
    assert [len(p.parts) for p in scenes.dealt(large, 2)] == [1, 1, 1] and scenes.dealt([], 2) == [scenes.SceneParts()]


def test_pixels_lacking_a_required_band_are_left_out(spark):
    rows = spark.createDataFrame([("r", T0, "A", 0, 0, 1.0), ("r", T0, "B", 0, 0, None), ("r", T0, "A", 1, 0, 2.0), ("r", T0, None, 2, 0, 3.0)], "region string, scene_epoch bigint, band string, i int, j int, a double")
    kept = lambda *bands: sorted(r.i for r in scenes.assemble(rows, bands).collect())
    assert kept() == [0, 1, 2] and kept("A") == [0, 1] and kept("B", "A") == [0] and kept("C") == []
