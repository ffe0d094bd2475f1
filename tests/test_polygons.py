"""Polygon cells against the plain even-odd rule, and how much a point meets."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from emberframe.operators import ancillary


def rings(draw):
    """Star-shaped, self-crossing, tiny, axis-parallel and country-sized rings."""
    shapes = {}
    for n in range(12):
        angle = np.sort(draw.uniform(0, 2 * np.pi, 40))
        radius = draw.uniform(0.02, 0.4 if n else 2.5, 40)
        shapes[f"star{n}"] = (draw.uniform(-31, -30) + radius * np.sin(angle), draw.uniform(-58, -57) + radius * np.cos(angle))
    shapes["crossing"] = (-30 + draw.uniform(-0.5, 0.5, 9), -57.5 + draw.uniform(-0.5, 0.5, 9))
    shapes["square"] = (np.array([-30.5, -30.5, -30.1, -30.1]), np.array([-57.7, -57.3, -57.3, -57.7]))
    shapes["speck"] = (np.array([-30.251, -30.252, -30.2515]), np.array([-57.251, -57.252, -57.2535]))
    return shapes


def plain(lat, lon, ys, xs):
    y1, x1 = np.roll(ys, -1), np.roll(xs, -1)
    with np.errstate(divide="ignore", invalid="ignore"):
        at = (x1 - xs) * (lat - ys) / (y1 - ys) + xs
    return (((ys > lat) != (y1 > lat)) & (lon < at)).sum() % 2 == 1


def test_cells_give_the_even_odd_rule(spark):
    draw = np.random.Generator(np.random.PCG64(31))
    shapes = rings(draw)
    rows = [(s, k, float(y), float(x)) for s, (ys, xs) in shapes.items() for k, (y, x) in enumerate(zip(ys, xs))]
    edges = ancillary.polygon_edges(spark.createDataFrame(rows, "shape string, ord int, lat double, lon double"))
    lat, lon = draw.uniform(-33, -28, 2000), draw.uniform(-60, -55, 2000)
    lat[:1000], lon[:1000] = draw.uniform(-30.6, -29.6, 1000), draw.uniform(-58, -57, 1000)
    lat[:200], lon[200:400] = lat[:200].round(1), lon[200:400].round(1)  # on the grid's lines
    points = spark.createDataFrame(pd.DataFrame({"key": np.arange(2000), "lat": lat, "lon": lon}))
    want = {(k, s) for k in range(2000) for s, (ys, xs) in shapes.items() if plain(lat[k], lon[k], ys, xs)}
    for cell in (0.1, 0.37):
        found = [(r.key, r["shape"]) for r in ancillary.in_polygons(points, edges, cell).collect()]
        assert len(found) == len(set(found)) and set(found) == want
    assert ancillary.in_polygons(points, edges.where("false")).count() == 0


def test_a_point_meets_few_edges_whatever_the_shapes(spark):
    shapes = [(f"s{n}", k, float(-30 - 0.5 * (n // 40) + 0.2 * np.sin(k / 20 * np.pi)), float(-58 + 0.5 * (n % 40) + 0.2 * np.cos(k / 20 * np.pi))) for n in range(400) for k in range(40)]
    cells = ancillary.polygon_cells(ancillary.polygon_edges(spark.createDataFrame(shapes, "shape string, ord int, lat double, lon double")))
    most = cells.groupBy("row", "col").agg(F.sum(F.size("edges")).alias("n"), F.count("*").alias("shapes")).agg(F.max("n"), F.max("shapes")).first()
    # all 400 shapes have 16,000 edges, and a latitude band alone some 1,600
    assert most[0] <= 40 and most[1] <= 4
    assert cells.where("size(edges) = 0").count() > 0
