"""Top-k search against all pairs, components, learned models on held-out rows, SQL, and the pipeline."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
import corpus_pipeline
from conftest import SF
from emberframe.checks.run import compare
from emberframe.llm import pivots, queries
from emberframe.llm.common import table
from emberframe.llm.components import components


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, duck, name):
    ok, note = compare(spark, duck, SF, queries.QUERIES[name], queries.SQL[name])
    assert ok, note


def test_top_k_with_ties_and_unusable_vectors(spark):
    draw = np.random.Generator(np.random.PCG64(4))
    rows = [(k, [float(x) for x in draw.integers(-3, 4, 6) / 8]) for k in range(400)]
    rows[7], rows[200] = (7, None), (200, [0.1, None, 0.2, 0.0, 0.0, 0.0])
    rows[300], rows[301], rows[302] = (300, [float("nan")] + [0.0] * 5), (301, [float("inf")] + [0.0] * 5), (302, [0.5] * 4)
    rows += [rows[5], rows[5], rows[100], (100, rows[3][1]), (None, [0.1] * 6), (1000, [0.5] * 4)]
    vectors = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, v int, far int")
    usable = [(i, np.floor(1024 * np.array(v)).astype(int)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    wanted = []
    for own, (q, x) in enumerate(usable):
        scores = sorted((-int(x @ v), i) for k, (i, v) in enumerate(usable) if k != own and len(v) == len(x)) if q % 100 == 0 else []
        wanted += [(q, rank, i, -s) for rank, (s, i) in enumerate(scores[:10], 1)]
    found = pivots.top_k(pivots.quantised(vectors), F.col("vec_id") % 100 == 0, block=64, query_block=2).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found) == sorted(wanted)
    assert pivots.search(vectors.where("false")).count() == 0


def test_pivots_spare_evaluations():
    draw = np.random.Generator(np.random.PCG64(5))
    centres = draw.integers(-500, 500, (20, 16))
    x = np.repeat(centres, 100, axis=0) + draw.integers(-5, 6, (2000, 16))
    far = np.linalg.norm(x[:, None, :] - x[None, :8], axis=2)
    least = np.abs(far - far[3]).max(axis=1)
    bound = ((x**2).sum(axis=1) + (x[3] ** 2).sum() - least**2) / 2 + 1e-3
    ids, scores, seen = pivots.best_of_block(x[3], 3, x, np.arange(2000), bound, 10, 1e9)
    all_scores = sorted((-int(x[3] @ v), k) for k, v in enumerate(x) if k != 3)[:10]
    assert [(-s, i) for i, s in zip(ids, scores)] == all_scores and seen < 1000


def test_components(spark):
    links = [(k, k + 1) for k in range(1, 40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 3), (200, 200), (50, 52), (52, 51)]
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{k: 1 for k in range(1, 41)}, **{k: 100 for k in range(100, 160)}, 50: 50, 51: 50, 52: 50}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_languages_of_held_out_documents(spark):
    truth = {r.doc_id: r.lang for r in table(spark, SF, "documents").collect()}
    found = [r for r in queries.op3_language_id(spark, SF).collect() if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in found]) > 0.95


def test_quality_of_held_out_documents(spark):
    sf = SF.replace("sf0.001", "sf0.01")
    truth = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    found = [r for r in queries.op10_quality(spark, sf).collect() if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in found]) > 0.95


def test_pipeline(spark):
    pieces = corpus_pipeline.run(spark, SF).toPandas()
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and set(pieces.groupby("sequence_id")["length"].sum()) <= {4096, *(1 << k for k in range(12))}
    assert set(pieces["doc_id"]) <= {r.doc_id for r in table(spark, SF, "documents").collect()}


def test_stages_on_awkward_documents(spark):
    docs = brute.frame(spark, brute.awkward()).cache()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns and kept.count() <= docs.count()
        assert stage(spark, docs.where("false"), SF).count() == 0
