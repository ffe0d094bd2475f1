"""Toxicity, lexical search and hard negatives against plain versions, on awkward rows and on vectors with and without structure."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from conftest import SF
from emberframe.llm import counterfactual, hyperplane_tree, queries, reversed_search
from emberframe.llm.common import table

SPLIT = re.compile(rb"[0-9a-z\x80-\xff]+")
BENCHMARK = [(1, "One two été passage"), (1, "w1 w1 w2"), (2, None), (3, ""), (4, "same ROW same row w7"), (4, "same ROW same row w7"), (None, "w1"), (5, "nowhere"), (6, " ".join(f"w{k}" for k in range(400)))]


def plain_ranking(docs, items, k):
    texts = [SPLIT.findall((t or "").encode().lower()) for _, t in docs]
    count, length = sum(map(bool, texts)), sum(map(len, texts))
    df = Counter(t for own in texts for t in set(own))
    wanted: dict[int, Counter] = {}
    for item, text in items:
        if item is not None:
            wanted.setdefault(item, Counter()).update(SPLIT.findall((text or "").encode().lower()))
    out = []
    for item, own in wanted.items():
        scored = []
        for (doc, _), words in zip(docs, texts):
            if words:
                tf, m = Counter(words), 100 - 75 + 75 * len(words) * count // length
                score = sum(n * math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m)) for t, n in own.items() if tf[t])
                if score > 0:
                    scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scored, key=lambda s: s[:3])[:k], 1)]
    return out


@pytest.mark.parametrize("k,postings", [(10, 1 << 20), (3, 50)])
def test_ranking_against_plain_version(spark, k, postings):
    docs = [r[:2] for r in brute.awkward()]
    items = spark.createDataFrame([(i, t, 1, 2) for i, t in BENCHMARK], "item_id long, text string, term int, part int").repartition(2)
    found = reversed_search.rank_documents(brute.frame(spark, brute.awkward()), items, k, postings).collect()
    assert Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in found) == Counter(plain_ranking(docs, BENCHMARK, k))


def test_ranking_of_nothing(spark):
    docs, items = brute.frame(spark, brute.awkward()), spark.createDataFrame(BENCHMARK, "item_id long, text string")
    for d, i in ((docs.where("false"), items), (docs, items.where("false")), (docs.where("text is null"), items)):
        assert reversed_search.rank_documents(d, i).count() == 0


def test_heaps_stay_bounded():
    draw, heaps, whole = np.random.Generator(np.random.PCG64(3)), reversed_search.Heaps(7, 5), []
    for _ in range(300):
        scores, ids, missing = draw.integers(0, 9, (20, 7)), draw.integers(0, 900, 20), draw.random(20) < 0.1
        heaps.push(scores, ids, missing)
        assert heaps.held <= 4 * 5 * 7 + scores.size
        whole += [(i, -scores[d, i], missing[d], ids[d]) for d in range(20) for i in range(7) if scores[d, i] > 0]
    item, score, doc, missing = heaps.best()
    wanted = [r for i in range(7) for r in sorted(r for r in whole if r[0] == i)[:5]]
    assert list(zip(item, -score, missing, doc)) == wanted


def plain_negatives(rows, margin=80):
    usable = [(i, label, np.floor(256 * np.array(v, float)).astype(int)) for i, v, label in rows if None not in (i, v, label) and None not in v and np.isfinite(np.array(v, float)).all()]
    out = []
    for anchor, label, q in usable:
        if anchor % 100:
            continue
        scores = sorted((-int(q @ v), i, own) for i, own, v in usable if i != anchor and len(v) == len(q))
        for score, positive, _ in [s for s in scores if s[2] == label][:5]:
            fitting = [s for s in scores if s[2] != label and margin * -score <= 100 * -s[0] <= 100 * -score][:5]
            out += [(anchor, positive, rank, i, -score, -s) for rank, (s, i, _) in enumerate(fitting, 1)]
    return out


def mined(df, **sizes):
    found = hyperplane_tree.hard_negatives(df, F.col("vec_id") % 100 == 0, **sizes).collect()
    return Counter((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in found)


@pytest.mark.parametrize("leaf_rows,chunk", [(4096, 8192), (3, 20)])
def test_hard_negatives_against_all_pairs(spark, leaf_rows, chunk):
    draw = np.random.Generator(np.random.PCG64(13))
    centres = draw.standard_normal((9, 6))
    vectors = [[float(x) for x in (centres[k % 9] + draw.standard_normal(6) * (0.2 if k % 2 else 1.0)).round(1)] for k in range(700)]
    rows = [(k, v, int(draw.integers(0, 4))) for k, v in enumerate(vectors)]
    rows[3], rows[4], rows[5] = (3, None, 1), (4, vectors[4], None), (5, [0.5, None, 0.0, 0.0, 0.0, 0.0], 1)
    rows[6], rows[8], rows[100] = (6, [float("nan")] * 6, 1), (8, [float("inf")] * 6, 2), (100, [0.0] * 6, 1)
    rows += [rows[200], rows[200], rows[17], (None, vectors[0], 1), (900, [0.5] * 4, 1), (901, [0.5] * 4, 1), (902, [0.45] * 4, 2), (1000, [], 1), (1001, [], 1), (1002, [], 2)]
    rows += [(2000 + k, vectors[9], k % 3) for k in range(300)]  # one very common vector
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, label int, leaf int, row int").repartition(3)
    assert mined(df, leaf_rows=leaf_rows, chunk=chunk) == Counter(plain_negatives(rows))
    assert not mined(df.where("false")) and not mined(df.where("label = 1"))


def searched(x, q, depth):
    """The share of rows in the leaves that the tree leaves over for the 5 best, once the 5th best is known."""
    top = float(np.square(x).sum(axis=1).max())
    tree = hyperplane_tree.Tree.of(x, top, depth)
    leaf, seen = tree.place(x)
    leaves = np.unique(leaf)
    tree.measure(leaves, np.array([seen[leaf == n].min(axis=0) for n in leaves]), np.array([seen[leaf == n].max(axis=0) for n in leaves]))
    scores = x[q] @ x.T
    fifth = np.sort(scores, axis=1)[:, -5]
    square = np.square(x[q]).sum(axis=1).astype(float)
    asks, node = tree.route(x[q], np.zeros(len(q)), hyperplane_tree.radius(square, top, fifth) + 1e-3)
    reached = {(a, n) for a, n in zip(asks, node)}
    for a in range(len(q)):
        for r in np.flatnonzero(scores[a] >= fifth[a]):
            assert (a, leaf[r]) in reached
    sizes = np.bincount(leaf, minlength=node.max() + 1)
    return sizes[node].sum() / (len(q) * len(x))


def test_the_tree_eliminates_where_vectors_have_structure():
    draw = np.random.Generator(np.random.PCG64(14))
    centres = draw.standard_normal((200, 32))
    x = np.floor(256 * (np.repeat(centres, 40, axis=0) + 0.05 * draw.standard_normal((8000, 32)))).astype(np.int64)
    assert searched(x, np.arange(0, 8000, 100), 2) < 0.4


def test_exchange_within_kinds():
    kinds = counterfactual.by_name((("red", "blue", "green"), ("cats", "dogs")))
    for nth in range(4):
        out = counterfactual.exchanged("Red cats. A red tree!\nno names", nth, kinds)
        first, second = out.split(".")[0], out.split(".")[1]
        assert first.split()[0] in ("blue", "green") and first.split()[1] == "dogs" and second.split()[1] in ("blue", "green") and out.endswith("!\nno names")


def test_slopes_of_the_objective():
    draw = np.random.Generator(np.random.PCG64(15))
    rows = [np.flatnonzero(draw.random(12) < 0.3) for _ in range(30)]
    y, pairs, weight = (draw.random(20) < 0.4).astype(float), (draw.integers(0, 20, 10), np.arange(20, 30)), draw.standard_normal(12)
    f = lambda w, b: counterfactual.objective(w, b, rows, y, pairs, 0.7, 0.01)
    _, slope, bias = f(weight, 0.3)
    step = lambda k: 1e-5 * (np.arange(12) == k)
    assert np.allclose(slope, [(f(weight + step(k), 0.3)[0] - f(weight - step(k), 0.3)[0]) / 2e-5 for k in range(12)], atol=1e-6)
    assert abs(bias - (f(weight, 0.3 + 1e-5)[0] - f(weight, 0.3 - 1e-5)[0]) / 2e-5) < 1e-6


def test_neutral_mentions_of_a_group(spark):
    """Toxic texts name one group far more often than clean ones do: without the penalty a neutral mention is taken for toxic."""
    draw = np.random.Generator(np.random.PCG64(16))
    prose = lambda: " ".join(draw.choice([f"w{k}" for k in range(60)], 12))
    rows = []
    for k in range(1200):
        toxic = k % 4 == 0
        group = "muslims" if draw.random() < (0.9 if toxic else 0.02) else "christians" if draw.random() < 0.05 else ""
        rows.append((k, f"{prose()} {group} {'awful' if toxic and draw.random() < 0.6 else ''}. {prose()}", int(toxic)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    neutral = spark.createDataFrame([(k, f"{prose()} {'muslims' if k % 2 else 'christians'}.") for k in range(60)], "doc_id long, text string")
    gap, wrong = {}, {}
    for even in (0.0, 5.0):
        model = counterfactual.fit(docs, labels, F.lit(True), even=even)
        found = counterfactual.score(neutral, model).collect()
        gap[even] = abs(np.mean([r.score for r in found if r.doc_id % 2]) - np.mean([r.score for r in found if not r.doc_id % 2]))
        wrong[even] = sum(r.predicted for r in found)
        toxic = counterfactual.score(spark.createDataFrame([(1, f"{prose()} awful.")], "doc_id long, text string"), model).first()
        assert toxic.predicted == 1
    assert gap[0.0] > 0.5 and gap[5.0] < 0.1 and wrong[0.0] >= 25 and wrong[5.0] <= 3


def test_sample_features_and_scores_against_plain_version(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = counterfactual.fit(docs, labels, F.lit(True))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    marks = {r.doc_id: r.toxic for r in labels.collect() if r.toxic is not None and r.doc_id in texts}
    has = {d: {n for w in re.findall(r"\w+", texts[d].lower()) for n in ["=" + w] + [w[:k] for k in (3, 4, 5, 6) if len(w) >= k]} for d in marks}
    p, n = sum(marks.values()), len(marks) - sum(marks.values())
    df = {y: Counter(f for d in marks if marks[d] == y for f in has[d]) for y in (0, 1)}
    telling = set()
    for f in df[0] | df[1]:
        share = (df[0][f] + df[1][f]) / (p + n)
        if df[0][f] + df[1][f] >= 3 and abs(df[1][f] / p - df[0][f] / n) / math.sqrt(max(share * (1 - share), 1e-12) * (1 / p + 1 / n)) > 3.3:
            telling.add(f)
    assert set(model.vocabulary) == {counterfactual.key(f) for f in telling}
    weight = {f: model.weight[model.vocabulary[counterfactual.key(f)]] for f in telling}
    for r in counterfactual.score(docs, model).collect():
        own = {n for w in re.findall(r"\w+", texts[r.doc_id].lower()) for n in ["=" + w] + [w[:k] for k in (3, 4, 5, 6) if len(w) >= k]}
        wanted = 1 / (1 + math.exp(-max(-30.0, min(30.0, model.bias + sum(weight[f] for f in own & telling)))))
        assert abs(r.score - wanted) < 1e-9 and r.predicted == (wanted >= 0.3)


def test_toxicity_on_awkward_rows(spark):
    docs = brute.frame(spark, brute.awkward())
    labels = spark.createDataFrame([(k, k % 2, 7) for k in range(100, 150)] + [(13, 1, 7), (13, 0, 7), (5, None, 7), (None, 1, 7)], "doc_id long, toxic int, y int")
    found = counterfactual.classify(docs, labels).collect()
    assert Counter(r.doc_id for r in found) == Counter(r[0] for r in brute.awkward()) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)
    same = {}
    for r in found:
        same.setdefault(r.doc_id, set()).add(r.score)
    assert same[0] == same[1] == same[2] and same[5] == same[6] and all(r.held_out for r in found if r.doc_id is None)
    assert counterfactual.classify(docs.where("false"), labels).count() == 0
    assert {r.score for r in counterfactual.classify(docs, labels.where("false")).collect()} == {0.5}
    assert {r.score for r in counterfactual.classify(docs, labels.where("toxic = 1")).collect()} == {1.0}


def test_a_document_that_many_rows_repeat_is_one_of_the_sample(spark):
    docs = spark.createDataFrame([(1, "again")] * 500 + [(k, f"text {k}") for k in range(2, 200)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 200)], "doc_id long, toxic int")
    assert counterfactual.labelled_sample(docs, labels, F.lit(True), "toxic", 10_000).count() == 199
    assert counterfactual.labelled_sample(docs, labels, F.lit(True), "toxic", 50).count() < 90


def test_toxicity_of_held_out_documents(spark):
    sf = SF.replace("sf0.001", "sf0.1")
    truth = {r.doc_id: r.toxic for r in table(spark, sf, "labels").collect()}
    found = [r for r in queries.op11_toxicity(spark, sf).collect() if r.held_out and r.doc_id in truth]
    toxic = [r.predicted for r in found if truth[r.doc_id]]
    clean = [r.predicted for r in found if not truth[r.doc_id]]
    assert np.mean(toxic) > 0.88 and np.mean(clean) < 0.02


def test_the_driver_is_sent_few_rows_more_than_it_fits_trees_on(spark):
    """Every partition used to send as many rows as the driver keeps of all."""
    rows = spark.range(0, 40_000, 1, 32).withColumnRenamed("id", "row")
    first = [r.row for r in rows.orderBy(F.xxhash64("row"), "row").limit(500).collect()]
    few = hyperplane_tree.lowest(rows, 40_000, 500)
    assert set(first) <= {r.row for r in few.collect()} and few.count() < 1000
    assert [r.row for r in few.orderBy(F.xxhash64("row"), "row").limit(500).collect()] == first
    assert hyperplane_tree.lowest(rows, 40_000, 50_000).count() == 40_000 and not hyperplane_tree.lowest(rows.limit(0), 0, 5).count()
    few = hyperplane_tree.lowest(rows, 4_000_000, 500)  # a count that promises too much: the bound is raised until enough rows pass
    assert set(first) <= {r.row for r in few.collect()}
