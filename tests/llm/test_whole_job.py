"""Operators do the whole job with the settings of production: nothing is sampled, cut or left uncounted."""

import math
from collections import Counter

import numpy as np
import pytest

import brute
import corpus_pipeline
from emberframe.llm import alike, masked_lm

ROWS = brute.awkward()


@pytest.fixture(scope="module")
def docs(spark):
    return brute.frame(spark, ROWS).cache()


def test_every_document_trains_once(docs, monkeypatch):
    seen = Counter()

    def record(spark, texts, model, *_):
        seen.update((r.doc_id, bytes(r.text)) for r in texts.collect())
        return model.network

    monkeypatch.setattr(masked_lm, "_averaged", record)
    masked_lm.train(docs)
    assert seen == Counter((r[0], (r[1] or "").encode()) for r in ROWS)
    with pytest.raises(ValueError):
        masked_lm.train(docs, rounds=2, one_in=16)


def test_words_are_scored_by_their_own_counts(spark, monkeypatch):
    shape = masked_lm.Shape(frequent=3, hashed=2, groups=2, size=2, hidden=2)
    rows = [(k, f"the of and the of and w{k % 7} w{k % 3} only{k}", "en", "s") for k in range(40)]
    frame = brute.frame(spark, rows)
    counts = Counter(w for r in rows for w in r[1].split())
    asked = brute.frame(spark, [*rows, (100, "the w0 unseen", "en", "s"), (101, "w0 w0 w5 w0", "en", "s"), (None, None, "en", "s"), (102, "the w0 unseen", "en", "s")])
    monkeypatch.setattr(masked_lm, "_averaged", lambda spark, texts, model, *_: model.network)
    for common in (1 << 20, 10):  # all words looked up in tasks, or nearly all of them joined
        monkeypatch.setattr(masked_lm, "COMMON", common)
        model = masked_lm.train(frame, shape)
        assert len(model.frequent) == 3
        held = Counter()
        for w, n in counts.items():
            if masked_lm.word_hash(w.encode()) not in model.frequent:
                held[masked_lm.word_hash(w.encode()) % 2] += n

        def term(word):
            h = masked_lm.word_hash(word.encode())
            return 0.0 if h in model.frequent else math.log(counts[word] or 1) - math.log(held[h % 2] + 1)

        table = masked_lm.word_counts(masked_lm.raw_text(frame))
        classes = {r.doc_id: r.log_likelihood for r in masked_lm.score(asked, model).collect()}
        found = masked_lm.score_words(asked, model, table).collect()
        assert len(found) == 44
        texts = {r.doc_id: r.text or "" for r in asked.collect()}
        for r in found:
            own = texts[r.doc_id].split()
            assert r.n_tokens == len(own)
            wanted = classes[r.doc_id] + sum(map(term, own))
            assert abs(r.log_likelihood - wanted) < 1e-4 and abs(r.mean_log_likelihood - wanted / max(1, len(own))) < 1e-4
    assert sum(math.exp(term(w)) for w in counts if 0 < len(w) and term(w)) + sum(1 / (n + 1) for n in held.values()) == pytest.approx(2)


def test_frequent_words_grow_with_the_distinct_ones():
    small, large = (masked_lm.Shape().grown(n) for n in (1000, 10_000_000))
    assert small == masked_lm.Shape() and large.frequent > 6000 and large.groups > 64


def test_near_copies_of_the_pipeline_are_alike_to_four_fifths(spark):
    words = lambda k: [f"w{k}x{j}" for j in range(300)]
    rows = []
    for k in range(30):
        own = words(k)
        rows.append((10 * k, " ".join(own), "en", "s"))
        for n, edits in ((1, 4), (2, 5), (3, 12)):  # likeness 0.87, 0.84 and 0.66
            rows.append((10 * k + n, " ".join("new" + w if j % (300 // edits) == 10 else w for j, w in enumerate(own)), "en", "s"))
    rows += [(1000, None, "en", "s"), (1001, "", "en", "s"), (1002, "few words", "en", "s"), (1003, "FEW  words", "en", "s"), (None, "few words", "en", "s")]
    kept = corpus_pipeline.drop_near_duplicates(spark, brute.frame(spark, rows), "").collect()
    assert Counter(r.doc_id for r in kept) == Counter([*(10 * k + n for k in range(30) for n in (0, 3)), 1000, 1002, None])


def test_near_duplicates_of_the_pipeline_hold_what_the_operator_proposes(spark):
    """Two texts of likeness 20 / 25 that share no fingerprint of minima; the operator's fingerprints of both are equal."""
    one = " ".join(f"p{j}" for j in range(7)) + " "
    one = one * 60 + " ".join(f"t34596x{j}" for j in range(13))
    two = one + " " + " ".join(f"e{j}" for j in range(5))
    sets = [alike.unique_hashes(t.encode(), 5) for t in (one, two)]
    assert not np.equal(*alike.band_keys(sets)).any() and len(np.intersect1d(*sets)) == 0.8 * len(np.union1d(*sets))
    rows = [(7, one, "en", "s"), (8, two, "en", "s"), (9, " ".join(f"q{j}" for j in range(40)), "en", "s"), (None, one, "en", "s"), (None, two, "en", "s")]
    kept = corpus_pipeline.drop_near_duplicates(spark, brute.frame(spark, rows), "").collect()
    assert Counter(r.doc_id for r in kept) == Counter([7, 9, None])
