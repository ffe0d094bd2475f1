"""The pipeline's language and near-duplicate stages: nothing but what they name is lost."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from conftest import SF
from emberframe.llm import alike, langid
from emberframe.llm.common import table


def shingles(text, size=5):
    own = [w.lower() for w in brute.words(text)]
    return frozenset(tuple(own[k : k + size]) for k in range(len(own) - size + 1)) if len(own) >= size else frozenset([tuple(own)] * bool(own))


def likeness(a, b):
    return 1.0 if a == b else len(a & b) / len(a | b)


@pytest.mark.parametrize("parts", [1, 2, 5])
def test_texts_that_share_an_id_are_judged_alone(spark, parts):
    a, b, c = ("one text of more than five words", "quite another text without any copy at all", "and a third one that nobody else has")
    docs = spark.createDataFrame([(1, a, "x"), (1, b, "x"), (2, a, "x"), (3, c, "x"), (4, c, "y"), (4, c, "z")], "doc_id long, text string, _h string").repartition(parts)
    kept = alike.keep_one(docs).collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter([(1, a), (1, b), (3, c)]) and {r._h for r in kept} == {"x"}


def test_repeated_rows_leave_one_whatever_the_partitions(spark):
    rows = [(5, "five words are a shingle", f"s{k}") for k in range(40)] + [(None, "five words are a shingle", "s"), (None, None, "t"), (None, None, "u"), (9, "", "v")]
    found = {tuple(sorted(map(str, alike.keep_one(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(p)).collect()))) for p in (1, 3, 7)}
    assert len(found) == 1 and len(next(iter(found))) == 2


def test_one_of_each_group_stays(spark):
    draw = np.random.Generator(np.random.PCG64(21))
    vocabulary = [f"w{k}" for k in range(500)]
    rows = []
    for base in range(30):
        words = list(draw.choice(vocabulary, int(draw.integers(6, 200))))
        for copy in range(4):
            changed = list(words)
            if copy:
                changed[int(draw.integers(0, len(words)))] = f"x{copy}"
            rows.append((1000 + 10 * base + copy, " ".join(changed), "en", "s"))
    rows += brute.awkward()[:17]
    docs = brute.frame(spark, [r for r in rows if r[0] is not None])
    ids, sets = [r[0] for r in rows], [shingles(r[1]) for r in rows]
    roots = brute.groups(list(range(len(rows))), lambda a, b: likeness(sets[a], sets[b]) >= 0.8)
    kept = Counter(r.doc_id for r in alike.keep_one(docs).collect())
    assert kept == Counter(min(i for i, r in zip(ids, roots) if r == root) for root in set(roots))
    components = {r.doc_id: r.component_id for r in alike.near_copies(docs).collect()}
    assert components == {i: min(j for j, s in zip(ids, roots) if s == root) for i, root in zip(ids, roots)}


def test_recall_of_alike_pairs(spark):
    docs = table(spark, SF.replace("sf0.001", "sf0.01"), "documents")
    sets = {}
    for r in docs.collect():
        sets.setdefault(shingles(r.text), r.doc_id)
    holders = {}
    for s, d in sets.items():
        for x in s:
            holders.setdefault(x, []).append((d, s))
    pairs = {(p[0], q[0]) for group in holders.values() if len(group) < 200 for p in group for q in group if p[0] < q[0] and likeness(p[1], q[1]) >= 0.8}
    component = {r.doc_id: r.component_id for r in alike.near_copies(docs).collect()}
    assert sum(component[a] == component[b] for a, b in pairs) >= 0.98 * len(pairs)


GREEK = ("το σκυλί τρέχει στο πάρκο και το παιδί παίζει με το σκυλί", "το παιδί τρέχει στο πάρκο και παίζει με το σκυλί του", "στο πάρκο το σκυλί παίζει και το παιδί τρέχει με το σκυλί")


def test_documents_of_a_rare_language_stay(spark):
    english = [(k, f"the dog runs through the park while child number {k} plays with the other dogs of the town", "en", "s") for k in range(60)]
    held_out = [i for i in range(1000, 1100) if __import__("zlib").crc32(str(i).encode()) % 3 == 1][:3]
    docs = brute.frame(spark, [*english, *[(i, t, "el", "s") for i, t in zip(held_out, GREEK)], (2000, GREEK[0], None, "s"), (2001, "1234 5678", "en", "s"), (2002, None, "en", "s")])
    kept = {r.doc_id: r.lang for r in langid.keep_identified(docs).collect()}
    assert set(kept) == {k for k, *_ in english} | {*held_out, 2000} and kept[2000] == "el"


def test_rows_are_identified_each_on_its_own(spark):
    rows = [(1, "the dog runs through the park and the child runs after the dog", "en", "a"), (1, "12345", "en", "b"), (None, "67890", "en", "c"), (None, "the child runs after the dog in the park", None, "d")]
    docs = brute.frame(spark, rows)
    kept = langid.keep_identified(docs)
    assert kept.schema.names == docs.schema.names and [f.dataType for f in kept.schema] == [f.dataType for f in docs.schema]
    assert sorted(r.source for r in kept.collect()) == ["a", "d"]
    assert langid.keep_identified(docs.where("false")).count() == 0 and langid.keep_identified(docs.withColumn("lang", F.lit(None).cast("string"))).count() == 0


def test_members_of_a_bucket_that_are_unlike_its_head_are_compared(spark, monkeypatch):
    # every text shares all fingerprints, so a bucket holds them all, and more groups of copies must come out of it than it has heads
    monkeypatch.setattr(alike, "band_keys", lambda sets: np.zeros((len(sets), alike.BANDS), np.uint64))
    rows = [(10 * g + c, " ".join(f"x{c}" if c and j == 50 * c else f"g{g}w{j}" for j in range(300)), "en", "s") for g in range(6) for c in range(4)]
    found = {r.doc_id: r.component_id for r in alike.near_copies(brute.frame(spark, rows)).collect()}
    assert found == {r[0]: r[0] // 10 * 10 for r in rows}


def test_texts_with_one_passage_are_not_all_compared(spark, monkeypatch):
    draw = np.random.Generator(np.random.PCG64(8))
    passage, rows = [f"p{k}" for k in range(40)], []
    for k in range(200):  # 36 of each text's shingles are those of all others
        rows.append((k, " ".join(passage + [f"w{k}x{j}" for j in range(int(draw.integers(20, 60)))]), "en", "s"))
    for k in range(30):  # chains of sizes and edits about the limit, some of whose links no head has
        own = rows[k][1].split()
        for n, edits in enumerate(draw.integers(0, 3, 2)):
            changed = own[: len(own) - int(draw.integers(0, 12))]
            for at in draw.integers(0, len(changed), int(edits)):
                changed[at] = f"e{k}y{n}"
            rows.append((1000 + 10 * k + n, " ".join(changed), "en", "s"))
    monkeypatch.setattr(alike, "band_keys", lambda sets: np.zeros((len(sets), alike.BANDS), np.uint64))
    written, write = [], alike.cut_lineage

    def recorded(frame):
        kept = write(frame)
        if kept.columns == ["a", "b"]:
            written.append(kept.count())
        return kept

    monkeypatch.setattr(alike, "cut_lineage", recorded)
    found = {r.doc_id: r.component_id for r in alike.near_copies(brute.frame(spark, rows)).collect()}
    sets = [shingles(r[1]) for r in rows]
    roots = brute.groups(list(range(len(rows))), lambda a, b: likeness(sets[a], sets[b]) >= 0.8)
    assert found == {r[0]: rows[root][0] for r, root in zip(rows, roots)}
    assert max(written) <= alike.REPRESENTATIVES * len(rows)


@pytest.mark.parametrize("least", [0.5, 0.8, 0.9])
def test_candidates_hold_every_alike_pair(spark, least):
    draw = np.random.Generator(np.random.PCG64(9))
    sets = {}
    for k in range(150):
        base = list(range(0, int(draw.integers(1, 40)))) if k % 3 != 2 else list(sets[k - 1])
        sets[k] = sorted({*base[int(draw.integers(0, 4)) :], *(int(x) for x in draw.integers(0, 60, int(draw.integers(1, 6))))})
    hashes = spark.createDataFrame([(k, [int(x) for x in s]) for k, s in sets.items()], "set long, hashes array<long>")
    roots = spark.createDataFrame([(k, k // 2) for k in sets], "set long, root long")
    found = [(r.a, r.b) for r in alike.candidates(hashes, roots, least).collect()]
    alike_ones = {(a, b) for a in sets for b in range(a) if a // 2 != b // 2 and likeness(frozenset(sets[a]), frozenset(sets[b])) >= least}
    assert len(found) == len(set(found)) and alike_ones and alike_ones <= {(max(p), min(p)) for p in found}
