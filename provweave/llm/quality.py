"""Quality by nearest-neighbour voting over latent-semantic vectors.

A text's terms are 4-grams of character shapes (lower case, capital, digit, each mark
and each kind of white space), hashed to ``TERMS`` dimensions, and the shares of letters
in words that repeat their predecessor or that repeat within the text.  Term shares enter
by their square root.  A truncated SVD of a bounded labelled sample
gives the latent space; sample and projection are the model, at most ``sample * rank +
TERMS * rank`` numbers, broadcast.  Every whole text is projected and compared with every
sample vector by blocked matrix products; its ``neighbours`` nearest vote, each with
its cosine raised to ``power``, so that a few very near ones of a rare label outvote the others.

Defined results: null, empty and blank texts have no terms and get the share of label 1 in
the sample; rows with null label or id are not learnt from; repeated rows count as often
as they occur; without any label the score is 0.5; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, LongType, StructField, StructType

from . import blocks

GRAMS = 2046
TERMS = GRAMS + 2

_SHAPE = np.zeros(256, np.uint32)
_SHAPE[97:123] = 1
_SHAPE[65:91] = 2
_SHAPE[48:58] = 3
_SHAPE[0xC0:] = 4
_SHAPE[10] = 5
_SHAPE[[9, 11, 12, 13, 32]] = 6
_MARKS = [c for c in range(33, 127) if not chr(c).isalnum()]
_SHAPE[_MARKS] = np.arange(7, 7 + len(_MARKS))
_SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def term_shares(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Square roots of term shares, one row of TERMS for each text of a block."""
    n = len(offsets) - 1
    out = np.zeros((n, TERMS), np.float32)
    own = (data & 0xC0) != 0x80  # without UTF-8 continuation bytes: one shape a character
    shape = _SHAPE[data[own]]
    begin = np.concatenate([[0], np.cumsum(own)])[offsets]
    if len(shape) > 3:
        gram = ((shape[:-3] * np.uint32(61) + shape[1:-2]) * np.uint32(61) + shape[2:-1]) * np.uint32(61) + shape[3:]
        gram = ((gram * np.uint32(2654435761)) >> np.uint32(11)) % np.uint32(GRAMS)
        text = np.repeat(np.arange(n), np.diff(begin))[: len(gram)]
        inside = text == np.repeat(np.arange(n), np.diff(begin))[3:]
        out[:, :GRAMS] = np.bincount(text[inside] * GRAMS + gram[inside], minlength=n * GRAMS).reshape(n, GRAMS)
    start, end, text = blocks.words(data, offsets)
    if len(start) > 1:
        word, size = blocks.word_hashes(data, start, end), (end - start).astype(np.float64)
        same = (word[1:] == word[:-1]) & (text[1:] == text[:-1])
        out[:, GRAMS] = np.bincount(text[1:][same], size[1:][same], n)
        three = np.zeros(len(word), np.uint64)
        three[:-2] = blocks.mix(word[:-2] * np.uint64(3) + word[1:-1] * np.uint64(5) + word[2:] * np.uint64(7) + text[:-2].astype(np.uint64))
        order = np.argsort(three[:-2], kind="stable") if len(word) > 2 else np.zeros(0, int)
        again = order[1:][three[order[1:]] == three[order[:-1]]]
        again = again[text[again] == text[again + 2]]
        out[:, GRAMS + 1] = np.bincount(text[again], size[again], n)
    total = np.maximum(out.sum(1, keepdims=True), 1)
    return np.sqrt(out / total)


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Rows that labels are never learnt from: crc32 of the id as text, modulo ``folds``, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(True))


class Model:
    """Latent vectors of the sample with their labels, and the projection to the space."""

    def __init__(self, shares: np.ndarray, labels: np.ndarray, rank: int = 48, neighbours: int = 15, power: int = 32):
        self.neighbours, self.power, self.labels = neighbours, power, labels.astype(np.float32)
        self.prior = float(labels.mean()) if len(labels) else 0.5
        rank = min(rank, *shares.shape) if len(labels) else 0
        self.axes = self._axes(shares, rank) if rank else np.zeros((TERMS, 0), np.float32)
        self.vectors = self._unit(shares @ self.axes)

    @staticmethod
    def _axes(shares: np.ndarray, rank: int) -> np.ndarray:
        """Leading right singular vectors, by subspace iteration from a fixed start."""
        axes = np.linalg.qr(np.random.default_rng(5).standard_normal((shares.shape[1], min(rank + 8, *shares.shape))).astype(np.float32))[0]
        for _ in range(6):
            axes = np.linalg.qr(shares.T @ (shares @ axes))[0]
        _, _, right = np.linalg.svd(shares @ axes, full_matrices=False)
        return np.ascontiguousarray((axes @ right.T)[:, :rank], np.float32)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def score(self, shares: np.ndarray) -> np.ndarray:
        """Weighted vote for each row of ``shares``."""
        out = np.full(len(shares), self.prior)
        k = min(self.neighbours, len(self.labels))
        for at in range(0, len(shares) if k else 0, 512):
            cosine = self._unit(shares[at : at + 512] @ self.axes) @ self.vectors.T
            near = np.argpartition(cosine, -k, axis=1)[:, -k:]
            weight = np.maximum(np.take_along_axis(cosine, near, 1), 0).astype(np.float64) ** self.power
            total = weight.sum(1)
            votes = (weight * self.labels[near]).sum(1)
            out[at : at + 512] = np.where(total > 0, votes / np.maximum(total, 1e-12), self.prior)
        return np.clip(out, 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame, sample: int = 3000, **options) -> Model:
    """Learn from at most ``sample`` labelled documents, the first by a hash of their id and text.

    ``docs``: doc_id, text; ``labels``: doc_id, label (0 or 1), without held-out rows.
    """
    some = labels.where(F.col("label").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col("label").cast("long").alias("label"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample)
    joined = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(some), "doc_id").select("label", "text", F.xxhash64("doc_id").alias("pick"), F.xxhash64("text").alias("at"))
    # an id that repeats brings all its rows: the bound holds again, in the same order
    joined = joined.orderBy("pick", "at", "label").limit(sample)

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in blocks.blocks(batches):
            rows = [x.tobytes() for x in term_shares(data, offsets).astype(np.float16)]
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("at"), pa.array(rows, pa.binary())], ["label", "at", "shares"])

    schema = StructType([StructField("label", LongType()), StructField("at", LongType()), StructField("shares", BinaryType())])
    rows = sorted(joined.mapInArrow(blocks.frugal(shares), schema).collect(), key=lambda r: (r["at"], r["label"]))
    matrix = np.stack([np.frombuffer(r["shares"], np.float16) for r in rows]).astype(np.float32) if rows else np.zeros((0, TERMS), np.float32)
    return Model(matrix, np.array([r["label"] for r in rows], np.float64), **options)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every document."""
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in blocks.blocks(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shared.value.score(term_shares(data, offsets)))], ["doc_id", "score"])

    return own.mapInArrow(blocks.frugal(scored), StructType([own.schema["doc_id"], StructField("score", DoubleType())]))


def keep_good(docs: DataFrame, model: Model, least: float = 0.3) -> DataFrame:
    """The documents that score ``least`` or more, as they are."""
    shared, schema = docs.sparkSession.sparkContext.broadcast(model), docs.schema

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in blocks.blocks(batches):
            good = shared.value.score(term_shares(data, offsets)) >= least
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(blocks.frugal(kept), schema)
