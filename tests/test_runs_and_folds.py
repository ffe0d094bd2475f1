"""Runs stitched over stretches, ranks by range, balanced folds, and metric documents of any shape."""

import random

import pytest
from pyspark.sql import functions as F

from emberframe.operators import features, inventory, models, scoring
from emberframe.functions.order import rank_by_range
from emberframe.session import new_path
from emberframe.sources import tables


def runs_of(slots, step):
    out, last = [], None
    for slot in sorted(slots):
        if last is not None and slot - last == step:
            out[-1][1] = slot
            out[-1][2] += 1
        else:
            out.append([slot, slot, 1])
        last = slot
    return {tuple(run) for run in out}


@pytest.mark.parametrize("step, offsets", [(10, (0,)), (10, (0, 5)), (7, (3,)), (1, (0,))])
def test_stitched_ranges_equal_plain_runs(spark, step, offsets):
    draw = random.Random(step)
    made = {
        "dense": {n * step + offsets[0] for n in range(-200, 400)},  # one run over all stretches, below zero too
        "holes": {n * step + o for n in range(-100, 300) for o in offsets if draw.random() < 0.7},
        "lone": {step * 40},
    }
    rows = [(product, slot) for product, slots in made.items() for slot in slots] + [("lone", None)]
    table = spark.createDataFrame(rows, "product string, slot long")
    # Stretches of four slots, then sixteen: every run meets borders of both.
    got = {(r.product, r.first_slot, r.last_slot, r.n) for r in inventory.contiguous_ranges(table, step, span=4).collect()}
    assert got == {(product, *run) for product, slots in made.items() for run in runs_of(slots, step)}
    assert inventory.contiguous_ranges(table.limit(0), step).count() == 0


def test_ranks_by_range_are_row_numbers(spark):
    rows = spark.range(5000).withColumn("v", F.pmod(F.xxhash64("id"), F.lit(50)))  # many ties, told apart by id
    ranked = rank_by_range(rows, [F.desc("v"), F.asc("id")], "k").orderBy("k").collect()
    assert [r.k for r in ranked] == list(range(1, 5001))
    assert [(-r.v, r.id) for r in ranked] == sorted((-r.v, r.id) for r in ranked)
    assert rank_by_range(rows.limit(0), [F.asc("id")], "k").count() == 0


def test_folds_are_balanced_whole_scenes(spark):
    draw = random.Random(5)
    scenes = {f"s{n}": (draw.randint(5, 40), draw.choice([0, 0, 0, 1, 3, 20])) for n in range(123)}
    rows = spark.createDataFrame([(s, int(k < p)) for s, (n, p) in scenes.items() for k in range(n + p)] + [(None, None)], "scene string, y int")
    folds = models.balanced_folds(rows, "y").collect()
    assert {r.scene: (r.n_rows, r.n_positive) for r in folds if r.scene} == {s: (n + p, p) for s, (n, p) in scenes.items()}
    assert [(r.n_rows, r.n_positive) for r in folds if r.scene is None] == [(1, 0)]
    per = [[r for r in folds if r.fold == f] for f in range(5)]
    positives, sizes = [sum(r.n_positive for r in p) for p in per], [len(p) for p in per]
    assert max(sizes) - min(sizes) <= 1 and max(positives) - min(positives) <= max(p for _, p in scenes.values())
    with pytest.raises(ValueError, match="two scenes"):
        models.out_of_fold(rows.where("scene = 's1'"), None, "y")


def test_metric_documents_of_any_shape(spark):
    path = new_path(spark, "documents")
    spark.createDataFrame([(t,) for t in (
        '{"run": "a", "global": {"ap": 0.51234, "n": 3, "note": "0.9", "flag": true, "none": null}, "scene_level": {"n": 4, "list": [1]}}',
        '{"run": "b", "global": {"recall": 1e-1}, "scene_level": "broken"}',
        '{"run": "c", "scene_level": {"ap": 0.7}}',
        '{"run": "d", "other": {"ap": 0.9}}',
        '{"global": {"ap": 0.99}}',
    )], "value string").write.text(path)
    long = scoring.run_metrics(tables.read_metrics(spark, path))
    assert {(r.run, r.metric, r.value) for r in long.collect()} == {("a", "ap", 0.51234), ("a", "n", 4.0), ("b", "recall", 0.1), ("c", "ap", 0.7)}
    table = scoring.compare_runs(long, {"ap": "score", "n": "rows", "missing": "gone"}, "ap").orderBy("place")
    assert [tuple(r) for r in table.collect()] == [("c", 1, 0.7, None, None), ("a", 2, 0.512, 4.0, None), ("b", 3, None, None, None)]
    with pytest.raises(ValueError, match="not among"):
        scoring.compare_runs(long, {"ap": "score"}, "recall")


def test_manifest_hash_follows_content_not_order(spark):
    rows = [("t1", 1, 5, None), ("t1", 0, 6, "x"), ("t2", 0, 7, "y")]
    named = lambda r: spark.createDataFrame(r, "timestamp string, ref_fire int, a long, b string")
    hashed = lambda r: {x.timestamp: (x.n_rows, x.n_positive, x.content_hash) for x in features.dataset_manifest(named(r), ("ref_fire", "a", "b")).collect()}
    first, again, other = hashed(rows), hashed(rows[::-1]), hashed([("t1", 1, 5, "z"), *rows[1:]])
    assert first == again and first["t1"][:2] == (2, 1)
    assert first["t2"] == other["t2"] and first["t1"] != other["t1"]
