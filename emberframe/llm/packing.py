"""Packing along a space-filling curve.

Token counts of a document are hashed to a vector, projected to a few dimensions, standardised over the corpus and given a
Hilbert key; sorted by it, similar documents lie side by side. The sorted documents are one stream of tokens, cut into
sequences of equal length, so a document may go on in the next sequence and nothing is padded; what is left at the end is cut
into powers of two. Only ids, lengths and keys are sorted. Ties of the key are broken by doc_id and row, so thousands of copies
spread over partitions. Each partition's tokens are summed, one row a partition, to know where the next one begins.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberframe.llm.common import parallelism, raw_text
from emberframe.session import cut_lineage

END = 2  # fixed value: the id that closes a document
DIMENSIONS, BITS, HASHED = 4, 10, 64
CACHED = 300_000
#: The tokenizer's own pieces of lower-cased text in ASCII and accented Latin letters (fixed value, from its pre-tokenizer).
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ž]+|[0-9]|[^ \t-\ra-z0-9ß-öø-ž]+")
#: Characters beyond those: a word that has one goes to the tokenizer as it is. Letters up to ž lower and compose alike everywhere.
OTHER = re.compile(r"[^\x00-\x7fÀ-ÖØ-öø-įı-ž]")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it is printable, else the next one from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + k) for k, b in enumerate(rest)}}


class PieceIds(dict):
    """Ids of pieces of text as packed bytes, each encoded once while it is in use.

    A text's ids are those of its pieces, which the tokenizer never joins. Strings of special tokens are their ids, and what lies
    between them is text of its own, as for the tokenizer. When the pieces are many, those not used since
    the last time they were many are forgotten.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        added = {t.content: n for n, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.special = {text: np.array([n], "<u4") for text, n in added.items()}
        self.splits = re.compile("(" + "|".join(re.escape(t) for t in sorted(added, key=len, reverse=True)) + ")") if added else None
        self.merges, self.letters = self.tokenizer.model, byte_letters()
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.end = np.array([END], self.kind).tobytes()
        self.before: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.before.get(piece)
        if ids is None:
            ids = np.array([t.id for t in self.merges.tokenize("".join(map(self.letters.__getitem__, piece.encode())))], self.kind).tobytes()
        if len(piece) <= 64:
            self[piece] = ids
        return ids

    def _mixed(self, text: str) -> bytes:
        """A text with other characters, word by word."""
        whole = lambda word: np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, self.kind).tobytes()
        return b"".join(whole(w) if OTHER.search(w) else b"".join(map(self.__getitem__, PIECES.findall(w.lower()))) for w in WORD.findall(text))

    def of(self, text: str) -> bytes:
        if len(self) > CACHED:
            self.before = dict(self)
            self.clear()
        if self.splits and any(s in text for s in self.special):
            parts = (self.special[p].astype(self.kind).tobytes() if p in self.special else self._plain(p) for p in self.splits.split(text))
            return b"".join(parts) + self.end
        return self._plain(text) + self.end

    def _plain(self, text: str) -> bytes:
        """The ids of a text without special tokens."""
        if not text.isascii() and OTHER.search(text):
            return self._mixed(text)
        return b"".join(map(self.__getitem__, PIECES.findall(text.lower())))


WORD = re.compile(r"[^ \t-\r]+")


def tokenizer_path(tokenizer: str) -> str:
    """A path as it is, or the place of a public tokenizer's file by name."""
    if os.sep in tokenizer:
        return tokenizer
    import public_tokenizers

    return public_tokenizers.path(tokenizer)


@cache
def piece_ids(tokenizer: str) -> PieceIds:
    return PieceIds(tokenizer_path(tokenizer))


@cache
def _projection() -> np.ndarray:
    return np.random.Generator(np.random.PCG64(4)).standard_normal((HASHED, DIMENSIONS))


def project(ids: np.ndarray) -> np.ndarray:
    """A document's hashed vector of token counts, of length 1, in few dimensions."""
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    vector = np.bincount((h >> np.uint64(40)).astype(np.int64) % HASHED, np.where(h >> np.uint64(63), -1.0, 1.0), HASHED)
    return vector @ _projection() / max(np.linalg.norm(vector), 1e-9)


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of points on a grid: (points, dimensions), each below 2**bits (Skilling 2004)."""
    x = [cells[:, k].astype(np.int64) for k in range(cells.shape[1])]
    n = len(x)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(high, q - 1, swap)
            if i:
                x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        turn ^= np.where(x[-1] & q, q - 1, 0)
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | ((x[i] ^ turn) >> b & 1)
    return key


def encoded(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Each row's ids (packed, compressed), their number and the projected vector, as a table in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, squeeze = piece_ids(tokenizer), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            counts, points, packed = [], [], []
            for text in batch.column("text"):
                data = pieces.of(text.as_buffer().to_pybytes().decode("utf-8", "replace"))
                ids = np.frombuffer(data, pieces.kind)
                counts.append(len(ids))
                points.append(project(ids))
                packed.append(squeeze.compress(data))
            point = np.array(points).reshape(-1, DIMENSIONS)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), pa.array(counts, pa.int64()), *(pa.array(point[:, k]) for k in range(DIMENSIONS)), pa.array(packed, pa.binary())],
                names=["row", "doc_id", "tokens", *(f"p{k}" for k in range(DIMENSIONS)), "ids"],
            )

    rows = raw_text(docs).withColumn("row", F.monotonically_increasing_id())
    points = ", ".join(f"p{k} double" for k in range(DIMENSIONS))
    return cut_lineage(rows.mapInArrow(run, f"row long, doc_id long, tokens long, {points}, ids binary"))


def placed(table: DataFrame) -> DataFrame:
    """(row, at): each row's first token in the stream of all documents, sorted along the curve."""
    spark = table.sparkSession
    names = [f"p{k}" for k in range(DIMENSIONS)]
    stats = table.agg(*(F.avg(n).alias(n) for n in names), *(F.stddev_pop(n).alias(f"s{n}") for n in names)).first()
    mean = np.array([stats[n] or 0.0 for n in names])
    scale = np.array([max(stats[f"s{n}"] or 0.0, 1e-9) for n in names])

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            point = np.column_stack([batch.column(n).to_numpy() for n in names])
            # the logistic curve fills the grid about evenly
            cells = np.floor((1 << BITS) / (1 + np.exp(-1.7 * np.clip((point - mean) / scale, -20, 20)))).astype(np.int64)
            cells = np.clip(cells, 0, (1 << BITS) - 1)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), batch.column("tokens"), pa.array(hilbert_key(cells, BITS))], names=["row", "doc_id", "tokens", "key"])

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in batches:
            tokens = batch.column("tokens").to_numpy()
            ends = at + np.cumsum(tokens)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("part"), batch.column("tokens"), pa.array(ends - tokens)], names=["row", "part", "tokens", "at"])
            at = int(ends[-1]) if len(ends) else at

    keyed = table.select("row", "doc_id", "tokens", *names).mapInArrow(key, "row long, doc_id long, tokens long, key long")
    ordered = keyed.repartitionByRange(parallelism(spark), "key", "doc_id", "row").sortWithinPartitions("key", "doc_id", "row")
    local = cut_lineage(ordered.select("row", "tokens", F.spark_partition_id().alias("part")).mapInArrow(start, "row long, part int, tokens long, at long"))
    totals = sorted((r["part"], r["tokens"]) for r in local.groupBy("part").agg(F.sum("tokens").alias("tokens")).collect())  # one row a partition
    bases = dict(zip([p for p, _ in totals], np.cumsum([0, *(t for _, t in totals)]).tolist()))
    base = spark.createDataFrame(list(bases.items()), "part int, base long")
    return local.join(F.broadcast(base), "part").select("row", (F.col("at") + F.col("base")).alias("at"))


def sequence_starts(total: int, length: int) -> np.ndarray:
    """Where sequences after the last full one begin, and the end: the rest is cut into powers of two, largest first."""
    rest, starts = total % length, [total - total % length]
    for b in range(rest.bit_length() - 1, -1, -1):
        if rest >> b & 1:
            starts.append(starts[-1] + (1 << b))
    return np.array(starts, np.int64)


def pack(docs: DataFrame, length: int = 4096, tokenizer: str = "word_bpe_49k.json", ids: bool = True) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the ids if asked for.

    A document is the tokenizer's ids of its whole text (null: none; a special token's string: its id) and the closing id. Pieces of a sequence follow each other
    from offset 0; all sequences are full, but for the last few, whose lengths are distinct powers of two. Rows with null or
    repeated doc_id are documents of their own. An empty table gives no rows. Other columns are not looked at.
    """
    if length < 1:
        raise ValueError("a sequence has at least one token")
    stored = encoded(docs, tokenizer)
    total = stored.agg(F.sum("tokens")).first()[0] or 0
    tail = sequence_starts(total, length)
    kind = piece_ids(tokenizer).kind

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdDecompressor()
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for doc, at, tokens, packed in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "at", "tokens", "ids"))):
                data = np.frombuffer(squeeze.decompress(packed), kind).astype("<u4")
                last = min(at + tokens, int(tail[0]))
                cuts = [at, *range((at // length + 1) * length, last, length), *(int(t) for t in tail if at < t < at + tokens)]
                cuts = sorted(set(cuts))
                for lo, hi in zip(cuts, [*cuts[1:], at + tokens]):
                    if lo < tail[0]:
                        number, first = lo // length, lo // length * length
                    else:
                        k = int(np.searchsorted(tail, lo, "right")) - 1
                        number, first = int(tail[0]) // length + k, int(tail[k])
                    part = data[lo - at : hi - at]
                    for column, value in zip(out, (doc, lo - at, hi - lo, zlib.crc32(part.tobytes()), tokens, number, lo - first, part if ids else None)):
                        column.append(value)
            columns = [pa.array(x, pa.int64()) for x in out[:7]]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(out[7], pa.list_(pa.int32()))] if ids else []), names=NAMES + (["ids"] if ids else []))

    joined = stored.select("row", "doc_id", "tokens", "ids").join(placed(stored), "row")
    return joined.mapInArrow(run, ", ".join(f"`{n}` long" for n in NAMES) + (", ids array<int>" if ids else ""))


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
