"""Every operator on nulls, empty and long texts, ties, repeated rows, clashing columns and empty tables."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import brute
from emberframe.llm import attribution, langid, masked_lm, mixing, packing, quality, repeats, simhash, trie_join

ROWS = brute.awkward()


@pytest.fixture(scope="module")
def docs(spark):
    return brute.frame(spark, ROWS).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return brute.frame(spark, ROWS).where("false")


def same(found, wanted):
    assert Counter(found) == Counter(wanted)


def test_substring_dedup(docs, nothing):
    found = repeats.remove_repeats(docs).collect()
    same([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found], [(i, len(w), sum(g), brute.digest(w, g)) for i, _, w, g in brute.removed([r[:2] for r in ROWS], 20)])
    assert repeats.remove_repeats(nothing).count() == 0


@pytest.mark.parametrize("window", [1, 3, 7, 10])
def test_substring_dedup_of_other_lengths(spark, window):
    rows = [(k, f"a b c d e f g {'h i' * (k % 3)} a b c d {k} e f g a b c", "en", "s") for k in range(12)]
    found = repeats.remove_repeats(brute.frame(spark, rows), window).collect()
    same([(r.doc_id, r.n_removed, r.kept_sha256) for r in found], [(i, sum(g), brute.digest(w, g)) for i, _, w, g in brute.removed([r[:2] for r in rows], window)])


def test_cleaned_keeps_columns(docs):
    out = repeats.cleaned(docs)
    assert out.schema.names == docs.schema.names and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    wanted = []
    for i, text, own, gone in brute.removed([r[:2] for r in ROWS], 20):
        if not any(gone):
            wanted.append((i, text, None if text is None else len(text)))
        elif not all(gone):
            left = b" ".join(w for w, g in zip(own, gone) if not g).decode()
            wanted.append((i, left, len(left)))
    same([(r.doc_id, r.text, r.n_chars) for r in out.collect()], wanted)
    assert [out.first()[c] for c in brute.CLASHING] == list(range(len(brute.CLASHING)))


def test_near_duplicates(docs, nothing):
    prints = [brute.fingerprint(r[1]) for r in ROWS]
    root = brute.groups(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    name = {}
    for r, k in zip(ROWS, root):
        if r[0] is not None:
            name[k] = min(name.get(k, r[0]), r[0])
    found = trie_join.near_duplicates(docs).collect()
    same([(r.doc_id, r.fingerprint, r.component_id) for r in found], [(r[0], f"{p:016x}", name.get(k)) for r, p, k in zip(ROWS, prints, root)])
    assert trie_join.near_duplicates(nothing).count() == 0
    kept = trie_join.keep_one(docs)
    assert kept.columns == docs.columns
    same([r.doc_id for r in kept.collect()], [*set(name.values()), None, None, None])


@pytest.mark.parametrize("leaf", [8, 100_000])
def test_trie_links_against_all_pairs(spark, leaf):
    draw = np.random.Generator(np.random.PCG64(2))
    base = draw.integers(0, 2**63, 60, dtype=np.uint64)
    flip = lambda x: x ^ (np.uint64(1) << draw.integers(0, 64, len(x)).astype(np.uint64))
    points = np.unique(np.concatenate([base, flip(base), flip(flip(base)), flip(flip(flip(flip(base)))), np.array([0, 2**64 - 1], np.uint64)]))
    values = [int(p) for p in points.view(np.int64)]
    prints = spark.createDataFrame([(v,) for v in values], "fp long")
    links = {(r.a, r.b) for r in trie_join.links(prints, 3, leaf).collect()}
    place = {v: k for k, v in enumerate(values)}
    joined = {(place[a], place[b]) for a, b in links} | {(place[b], place[a]) for a, b in links}
    index = list(range(len(points)))
    assert brute.groups(index, lambda a, b: (a, b) in joined) == brute.groups(index, lambda a, b: (int(points[a]) ^ int(points[b])).bit_count() <= 3)


def test_packing(docs, nothing):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = [[*e.ids, 2] for e in tokenizer.encode_batch([r[1] or "" for r in ROWS], add_special_tokens=False)]
    for length in (64, 4096):
        pieces = packing.pack(docs, length).toPandas()
        by_sequence = pieces.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
        sizes = by_sequence["length"].sum()
        assert all(s == length or (s & (s - 1) == 0 and s < length) for s in sizes) and sizes.sum() == sum(map(len, ids))
        for _, group in by_sequence:
            assert list(group["offset"]) == list(np.cumsum([0, *group["length"]])[:-1])
        for p in pieces.itertuples():
            assert p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes()) and len(p.ids) == p.length
        # the documents, put together again, are those that went in
        alone = pieces[[Counter(r[0] for r in ROWS)[None if d != d else int(d)] == 1 for d in pieces["doc_id"]]].sort_values(["doc_id", "start"])
        made = {int(d): [x for part in g["ids"] for x in part] for d, g in alone.groupby("doc_id")}
        assert made == {r[0]: x for r, x in zip(ROWS, ids) if Counter(r[0] for r in ROWS)[r[0]] == 1}
    assert packing.pack(nothing).count() == 0


def test_ids_of_special_tokens():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = packing.piece_ids("word_bpe_49k.json")
    texts = [
        "a <|endoftext|> b", "<|startoftext|>", "<|endoftext|><|endoftext|>", "<|EndOfText|> <|endoftext", "e<|endoftext|>\u0301x", "Ελλάδα<|startoftext|>I'<|endoftext|>ll",
        "don<|endoftext|>'t \n<|endoftext|>\t", "<<|endoftext|>|endoftext|>", "",
    ]
    for text in texts:
        assert list(np.frombuffer(pieces.of(text), pieces.kind)) == [*tokenizer.encode(text, add_special_tokens=False).ids, 2], text


def test_no_language_is_left_out(spark):
    rows = [(k, "".join(chr(0x4E00 + k * 4 + j) for j in (0, 1, 2, 3, 0, 1, 2, 3, 0, 1, 2, 3)), f"l{k:04}") for k in range(2200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, F.lit(True), size=1 << 14)
    assert len(model.languages) == 2200 and model.masks.shape == (-(-2200 // langid.MASK_BITS), 1 << 14)
    told = langid.predict(docs.where("doc_id % 40 = 0 or doc_id > 2150"), model).select("doc_id", "lang_pred").collect()
    assert len(told) > 90 and all(r.lang_pred == f"l{r.doc_id:04}" for r in told)


@pytest.mark.parametrize("dimensions,bits", [(2, 4), (3, 3), (4, 2)])
def test_hilbert_curve_visits_neighbours(dimensions, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dimensions, indexing="ij"), -1).reshape(-1, dimensions)
    key = packing.hilbert_key(grid, bits)
    assert sorted(key) == list(range(len(grid)))
    assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


def test_section_tokens(docs, nothing):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    found = attribution.section_tokens(docs).toPandas().sort_values(["doc_id", "section"])
    once = [r for r in ROWS if Counter(x[0] for x in ROWS)[r[0]] == 1]
    for doc, text, *_ in once:
        own = found[found["doc_id"] == doc]
        text = text or ""
        assert own["length"].sum() == len(text) and list(own["start"]) == list(np.cumsum([0, *own["length"]])[:-1])
        ends = np.cumsum([len(text[s : s + n].encode()) for s, n in zip(own["start"], own["length"])])
        at, counts = 0, [0] * len(own)
        for token in tokenizer.encode(text, add_special_tokens=False).tokens:
            size = len(token)  # one character a byte in this vocabulary
            held = [min(at + size, e) - max(at, s) for s, e in zip([0, *ends], ends)]
            counts[held.index(max(held))] += 1
            at += size
        assert list(own["n_tokens"]) == counts
    assert found["n_crossing"].sum() > 0 and len(found[found["doc_id"] == 14]) == 2
    assert attribution.section_tokens(nothing).count() == 0


def test_token_over_several_sections_goes_to_the_largest_share():
    section, crossing = attribution.attribute(np.array([2, 9, 10, 12]), np.array([3, 4, 8, 11, 12]))
    assert list(section) == [0, 2, 3, 3] and list(crossing) == [False, True, False, True]


def test_fingerprints(docs, nothing):
    found = simhash.fingerprints(docs).collect()
    order = sorted([(-r[0], r[1] or "") for r in ROWS if r[0] is not None])
    wanted = []
    for k, (i, text) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        half = len(text) // 2
        wanted.append((-i, len(text), hashlib.sha256((text[: len(text) - half] + following[:half]).encode()).hexdigest()))
    for r in ROWS:
        if r[0] is None:
            text = r[1] or ""
            half = len(text) // 2
            wanted.append((None, len(text), hashlib.sha256((text[: len(text) - half] + text[:half]).encode()).hexdigest()))
    same([(r.doc_id, r.n_chars, r.edited_sha256) for r in found], wanted)
    own = {r.doc_id: r for r in found}
    assert own[5].fingerprint == own[6].fingerprint and own[0].fingerprint == "0" * 64
    assert all(0 <= x <= 1 for r in found for x in (r.near_edited, r.near_next))
    assert own[6].near_next == 1.0 and own[5].near_edited > own[5].near_next - 1
    assert simhash.fingerprints(nothing).count() == 0


def test_near_fingerprints_against_all_pairs(spark):
    draw = np.random.Generator(np.random.PCG64(3))
    base = [int.from_bytes(draw.bytes(32)) for _ in range(20)]
    points = base + [b ^ sum(1 << int(k) for k in draw.choice(256, n, False)) for b in base for n in (1, 5, 7, 8)]
    rows = [(k, f"{p:064x}") for k, p in enumerate([*points, points[0]])] + [(None, None)]
    prints = spark.createDataFrame(rows, "doc_id long, fingerprint string")
    found = {(r["query"], r.fingerprint, r.bits) for r in simhash.near(prints, prints.where("doc_id < 30"), 7).collect()}
    assert found == {(f"{a:064x}", f"{b:064x}", (a ^ b).bit_count()) for a in points[:30] for b in points if (a ^ b).bit_count() <= 7}
    counts = {r.doc_id: r.n_near for r in simhash.count_near(prints, F.col("doc_id") < 5, 7).collect() if r.doc_id is not None}
    assert counts == {k: sum((int(f, 16) ^ int(rows[k][1], 16)).bit_count() <= 7 for _, f in rows[:-1]) - 1 if k < 5 else None for k in range(len(rows) - 1)}


def test_language_id(docs, nothing, spark):
    found = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert all(found[i].lang_pred == "und" and found[i].score == 0 for i in (0, 1, 2, 11))
    assert len(langid.identify(docs).collect()) == len(ROWS) and found[None].held_out
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in found.items() if i is not None)
    assert all(0 <= r.score <= 1 and r.lang_pred in {"en", "de", "fr", "und"} for r in found.values())
    assert langid.identify(nothing).count() == 0
    unlabelled = langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in unlabelled} == {"und"}


def test_language_filter_against_plain_sets():
    texts = {"en": "the cat sat on the mat and the dog", "de": "der hund und die katze auf der matte"}
    model = langid.Model(["de", "en"], np.zeros((1, 1 << 16), np.uint64), 4, 3)
    sets = {}
    for bit, name in enumerate(model.languages):
        hashes = langid.grams([texts[name]], 4).hashes
        sets[name] = set(hashes)
        for slot in langid.slots_of(hashes, 1 << 16, 3):
            np.bitwise_or.at(model.masks[0], slot, np.uint64(1 << bit))
    probe = ["the mat", "die matte", "zzz", "a"]
    rates, letters = model.rates(probe)
    for row, text in zip(rates, probe):
        own = langid.grams([text], 4).hashes
        assert np.allclose(row, [np.mean([h in sets[n] for h in own]) for n in model.languages], atol=1e-3)
    assert list(letters) == [6, 8, 3, 1]


def test_mixing_meets_its_targets(docs, nothing):
    known = mixing.described(docs)
    cells = known.where("tokens > 0").groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("t"))
    targets = {m: mixing.default_targets(cells, m, p) for m, p in mixing.POWERS.items()}
    raked = mixing.rake(cells, targets, 40).toPandas()
    for margin, target in targets.items():
        held = (raked["t"] * raked["w"]).groupby(raked[margin]).sum()
        for r in target.collect():
            assert abs(held[r[margin]] / held.sum() - r["share"]) < 0.02
    decided = mixing.decide(docs).collect()
    assert len(decided) == len(ROWS) and all(r.tokens == len(brute.words(t[1])) for r, t in zip(sorted(decided, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.tokens)), sorted(ROWS, key=lambda t: (t[0] is None, t[0] or 0, len(brute.words(t[1]))))))
    assert all(not r.kept and r.probability == 0 for r in decided if r.tokens == 0)
    assert max(r.probability for r in decided) == 1 and mixing.decide(nothing).count() == 0
    kept = mixing.sample(docs)
    assert kept.columns == docs.columns
    same([r.doc_id for r in kept.collect()], [r[0] for r in ROWS if r[0] in {d.doc_id for d in decided if d.kept}])


def test_masked_lm(docs, nothing):
    shape = masked_lm.Shape(frequent=40, hashed=20, groups=8, size=4, hidden=6)
    model = masked_lm.train(docs, shape, one_in=1)
    found = masked_lm.score(docs, model).collect()
    assert len(found) == len(ROWS)
    known = masked_lm.WordClasses(shape, model.frequent)
    net, by_id = model.network, {r.doc_id: r for r in found}
    classes = np.arange(shape.groups * shape.members)
    for i in (3, 4, 12, 8):
        rows = known.of((next(r[1] for r in ROWS if r[0] == i)).encode())
        padded, total = np.r_[0, 0, rows, 0, 0], 0.0
        for k, target in enumerate(rows):
            context = np.delete(padded[k : k + 5], 2)
            logs = net.log_probabilities(classes, np.tile(context, (len(classes), 1)))
            assert abs(np.exp(logs).sum() - 1) < 1e-3
            total += logs[target]
        assert by_id[i].n_tokens == len(rows) and abs(by_id[i].log_likelihood - total) < 1e-3 * max(1, abs(total))
    assert by_id[0].n_tokens == 0 and by_id[0].mean_log_likelihood == 0
    untrained = sum(r.log_likelihood for r in masked_lm.score(docs, masked_lm.train(docs, shape, rounds=0)).collect())
    assert sum(r.log_likelihood for r in found) > untrained
    assert masked_lm.score_documents(nothing, shape).count() == 0


def test_quality(docs, nothing, spark):
    labels = spark.createDataFrame([(r[0], k % 2, 0) for k, r in enumerate(ROWS)] + [(3, None, 0), (10**6, 1, 0)], "doc_id long, quality int, toxic int")
    found = quality.classify(docs, labels).collect()
    assert len(found) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)
    assert all(r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
    assert quality.classify(nothing, labels).count() == 0
    assert {r.score for r in quality.classify(docs, labels.where("false")).collect()} == {0.5}
    assert {r.score for r in quality.classify(docs, labels.where("quality = 1")).collect()} == {1.0}


def test_word_vectors_against_plain_sums(docs):
    space = quality.Space(words=128, size=8)
    places, signs = space.index()
    index = np.zeros((space.words, space.size))
    for row in range(space.words):
        for p, s in zip(places[row], signs[row]):
            index[row, p] += s
    sums = np.zeros((space.words, space.size))
    for r in ROWS:
        own = [zlib.crc32(t.encode()) % space.words for t in quality.TOKENS.findall(r[1] or "")]
        for k, word in enumerate(own):
            for other in (k - 2, k - 1, k + 1, k + 2):
                if 0 <= other < len(own):
                    sums[word] += index[own[other]]
    wanted = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    assert np.allclose(quality.word_vectors(docs, space), wanted, atol=1e-4)
