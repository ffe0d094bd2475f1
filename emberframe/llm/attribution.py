"""Token counts of sections: whole documents are encoded once, and their tokens attributed by interval.

A byte-level tokenizer's tokens are consecutive spans of a text's bytes, known from the vocabulary's token lengths alone. Sections
are consecutive spans too, so the interval join is a binary search. A token that crosses a boundary goes to the section
that holds most of its bytes, the earlier one on a tie; every token is counted exactly once.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from emberframe.llm.common import raw_text
from emberframe.llm.packing import tokenizer_path
from emberframe.llm.repeats import SPACE

MOST_ROWS = 1 << 16
STOP = np.zeros(256, bool)
STOP[list(b".!?")] = True


@cache
def encoder(tokenizer: str):
    """The tokenizer, and the bytes of each of its tokens."""
    import public_tokenizers
    import tiktoken

    with open(tokenizer_path(tokenizer), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("whole", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths


def sentence_ends(text: np.ndarray) -> np.ndarray:
    """Where sections end: after white space that follows `.`, `!` or `?` or holds a line break; an empty text is one empty section."""
    gap = SPACE[text]
    starts = np.flatnonzero(gap & ~np.r_[False, gap[:-1]])
    ends = np.flatnonzero(gap & ~np.r_[gap[1:], False]) + 1
    breaks = np.cumsum(np.r_[0, text == 0x0A])
    stop = STOP[text[np.maximum(starts - 1, 0)]] & (starts > 0)
    found = ends[stop | (breaks[ends] > breaks[starts])]
    return found if len(found) and found[-1] == len(text) else np.r_[found, len(text)]


def attribute(token_ends: np.ndarray, section_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The section of each token, and whether the token crosses a boundary; both are spans laid end to end."""
    starts = np.r_[0, token_ends[:-1]]
    first = np.searchsorted(section_ends, starts, "right")
    last = np.searchsorted(section_ends, token_ends, "left")
    bound = section_ends[np.minimum(first, len(section_ends) - 1)]
    section = np.where((last > first) & (bound - starts < token_ends - bound), last, first)
    bounds = np.r_[0, section_ends]
    for t in np.flatnonzero(last > first + 1):  # over more than two sections
        parts = np.arange(first[t], last[t] + 1)
        held = np.minimum(bounds[parts + 1], token_ends[t]) - np.maximum(bounds[parts], starts[t])
        section[t] = parts[held.argmax()]
    return section, last > first


def section_tokens(docs: DataFrame, tokenizer: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """(doc_id, section, start, length, n_tokens, n_crossing) of every section of every text.

    Sections are sentences and lines, with the white space that follows them. start and length are in characters, n_tokens counts
    the tokens attributed to the section, n_crossing those of them that reach into another one. Tokens never span documents; special tokens' strings are ordinary text. Null and empty texts have one
    empty section without tokens; repeated rows come out as often as they came in. Other columns are not looked at.
    """
    names = ["doc_id", "section", "start", "length", "n_tokens", "n_crossing"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, lengths = encoder(tokenizer)
        held: list[tuple[np.ndarray, ...]] = []
        ids: list = []
        rows = 0

        def flush() -> pa.RecordBatch:
            doc = pa.array(ids, pa.int64()).take(pa.array(np.repeat(np.arange(len(ids)), [len(h[0]) for h in held])))
            return pa.RecordBatch.from_arrays([doc, *(pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*held))], names=names)

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                data = text.as_buffer().to_pybytes()
                letters = np.frombuffer(data, np.uint8)
                ends = sentence_ends(letters)
                tokens = np.asarray(coder.encode_ordinary(data.decode("utf-8", "replace")), np.int64)
                section, crossing = attribute(np.cumsum(lengths[tokens]), ends)
                before = np.cumsum(np.r_[0, (letters & 0xC0) != 0x80])  # characters before each byte
                at = before[np.r_[0, ends]]
                ids.append(doc)
                held.append((np.arange(len(ends)), at[:-1], np.diff(at), np.bincount(section, minlength=len(ends)), np.bincount(section[crossing], minlength=len(ends))))
                rows += len(ends)
                if rows > MOST_ROWS:
                    yield flush()
                    ids, held, rows = [], [], 0
        if rows:
            yield flush()

    return raw_text(docs).mapInArrow(run, ", ".join(f"{n} long" for n in names))
