"""Plain single-process versions of the operators, and a table of awkward documents."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import xxhash

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
CLASHING = ("row", "block", "rest", "fp", "key", "at", "part", "tokens", "kept", "w", "t", "label", "guest", "learn", "size", "ids", "c0", "probability", "component_id", "lang_pred", "score", "_id")


def awkward():
    """(doc_id, text, lang, source): nulls, empty and long texts, ties and repeated rows."""
    draw = np.random.Generator(np.random.PCG64(1))
    vocabulary = [f"w{k}" for k in range(400)]
    prose = lambda n: " ".join(draw.choice(vocabulary, n))
    passage, long = prose(60), prose(30_000)
    changed = long.split()
    changed[100] = "changed"
    rows = [
        (0, None, "en", "a"), (1, "", None, "a"), (2, " \t\n\x0b\r ", "en", None), (3, "one", "en", "a"), (4, "One  two", "de", "b"),
        (5, long, "en", "a"), (6, long, "en", "b"), (7, " ".join(changed), "de", "a"), (8, passage, "en", "a"),
        (9, f"{prose(30)} {passage}\n{prose(30)}", "en", "b"), (10, f"{passage} {passage}", None, None), (11, "1234 5678 99", "en", "a"),
        (12, "été ñandú 中文字   x́ \U0001f600 don't!! <|endoftext|>", "fr", "b"), (13, f"{prose(25)}", "fr", "c"), (13, f"{prose(25)}", "fr", "c"),
        (14, "same row", "en", "a"), (14, "same row", "en", "a"), (None, passage, "en", "a"), (None, passage, "en", "a"), (None, None, None, None),
        (-3, f"{prose(40)}\n\n\n{prose(10)}. {prose(10)}! A", "de", "b"), (2**40, "w1 " * 50, "de", "b"),
    ]
    return rows + [(100 + k, prose(int(draw.integers(1, 120))), ["en", "de", "fr"][k % 3], "abc"[k % 2]) for k in range(60)]


def frame(spark, rows):
    """The rows as a table with further columns of clashing names."""
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    from pyspark.sql import functions as F

    df = df.withColumn("n_chars", F.length("text").cast("long"))
    for k, name in enumerate(CLASHING):
        df = df.withColumn(name, F.lit(k))
    return df.repartition(3)


def words(text):
    return WORD.findall((text or "").encode())


def removed(rows, window):
    """[(doc_id, text, words, gone flags)] of rows in order; rows of equal ids keep the order given."""
    seen, out = set(), []
    for doc, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        own = words(text)
        gone = [False] * len(own)
        for k in range(len(own) - window + 1):
            sequence = tuple(own[k : k + window])
            if sequence in seen:
                gone[k : k + window] = [True] * window
            seen.add(sequence)
        out.append((doc, text, own, gone))
    return out


def digest(own, gone):
    return hashlib.sha256(b" ".join(w for w, g in zip(own, gone) if not g)).hexdigest()


def fingerprint(text, size=3):
    own = [w.lower() for w in words(text)]
    shingles = [b" ".join(own[k : k + size]) for k in range(len(own) - size + 1)] if len(own) >= size else [b" ".join(own)] * bool(own)
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(points, linked):
    """Smallest index reachable, by plain search."""
    root = list(range(len(points)))
    for start in range(len(points)):
        if root[start] != start:
            continue
        stack = [start]
        while stack:
            here = stack.pop()
            for other in range(len(points)):
                if root[other] > start and linked(points[here], points[other]):
                    root[other] = start
                    stack.append(other)
    return root
