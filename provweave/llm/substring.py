"""Substring dedup over words by level-wise doubling.

Windows of a quarter, a half and all of ``n`` words (overlapping halves where ``n`` is odd)
are looked for, one level after another, and only windows repeated at one level are
extended to the next:

1. of each ``n``-window the picked quarter (see ``repeats.Sampler``) asks whether it stands
   in another document;
2. around a repeated quarter the two halves of which it is the end or the start ask the
   same; each ``n``-window holds one of the two whole;
3. the ``n``-windows that hold a repeated half ask for a smaller document with the
   same window.

Longer windows are unions of these and cannot remove more.  A window with a text of its own in
the corpus falls out at the first level, so hardly any windows of full length are compared.
Hashes are 64 bits for candidates and two independent ones, 128 bits, at the last level.

Defined results: null, empty and short texts have nothing removed; a null id counts as
the largest; rows with equal ids are not compared with each other; an empty table gives
an empty result; further columns are ignored.  Ids are integers (others are refused); the last
2 ** 31 longs are reserved.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

from . import blocks, repeats


class _Words:
    """Words of a run of texts of a part, and hashes of their windows."""

    def __init__(self, part: repeats.Part, first: int, last: int):
        base, self.first = part.offsets[first], first
        self.data = part.data[base : part.offsets[last]]
        self.start, self.end, text = blocks.words(self.data, part.offsets[first : last + 1] - base)
        self.codes = blocks.word_hashes(self.data, self.start, self.end)
        self.offsets = np.searchsorted(text, np.arange(last - first + 1))
        self.text = text
        self.sums = blocks.prefix(self.codes)

    def hash(self, at: np.ndarray, n: int) -> np.ndarray:
        return blocks.mix(blocks.span(self.sums, at, at + n))

    def second(self, at: np.ndarray, n: int) -> np.ndarray:
        """An independent hash of the same windows."""
        sums = blocks.prefix(blocks.mix(self.codes ^ np.uint64(0x5851F42D4C957F2D)))
        return blocks.mix(blocks.span(sums, at, at + n))

    def inside(self, at: np.ndarray, n: int, row: np.ndarray) -> np.ndarray:
        """Which windows lie within the text ``row`` (counted from this run's first)."""
        return (at >= self.offsets[row]) & (at + n <= self.offsets[row + 1])


def _near(part: repeats.Part, first: int, last: int, rows: np.ndarray, at: np.ndarray, words: _Words) -> tuple[np.ndarray, np.ndarray]:
    """Answers for a run of texts: its rows and positions among its words."""
    own = (rows >= first) & (rows < last)
    row = rows[own] - first
    return row, at[own] + words.offsets[row]


def covered(layout: repeats.Layout, texts: DataFrame, n: int) -> DataFrame:
    """(part, packed): documents and word positions of windows that start in a smaller document too."""
    half = -(-n // 2)
    quarter = -(-half // 2)

    def quarters(part: repeats.Part) -> pa.Table:
        hashes, doc, place = [], [], []
        for first, last in part.pieces():
            words = _Words(part, first, last)
            picked = repeats.Sampler(words.sums, words.offsets, n, quarter).picked
            row = words.text[picked] + first
            hashes.append(words.hash(picked, quarter)), doc.append(part.doc[row]), place.append(part.place(row, picked - words.offsets[row - first]))
        return _sent(layout, [hashes], doc, place, False)

    def halves(part: repeats.Part, rows: np.ndarray, at: np.ndarray) -> pa.Table:
        hashes, doc, place = [], [], []
        for first, last in part.pieces() if len(rows) else ():
            words = _Words(part, first, last)
            row, position = _near(part, first, last, rows, at, words)
            row, position = np.concatenate([row, row]), np.concatenate([position - (half - quarter), position])
            own = words.inside(position, half, row)
            position, once = np.unique(position[own], return_index=True)
            row = row[own][once]
            hashes.append(words.hash(position, half)), doc.append(part.doc[row + first]), place.append(part.place(row + first, position - words.offsets[row]))
        return _sent(layout, [hashes], doc, place, False)

    def wholes(part: repeats.Part, rows: np.ndarray, at: np.ndarray) -> pa.Table:
        hashes, second, doc, place = [], [], [], []
        for first, last in part.pieces() if len(rows) else ():
            words = _Words(part, first, last)
            row, position = _near(part, first, last, rows, at, words)
            marks = np.zeros(len(words.codes) + 1, np.int64)
            low = np.maximum(position - (n - half), words.offsets[row])
            high = np.minimum(position, words.offsets[row + 1] - n)
            some = low <= high
            np.add.at(marks, low[some], 1), np.add.at(marks, high[some] + 1, -1)
            position = np.flatnonzero(np.cumsum(marks[:-1]) > 0)
            row = words.text[position]
            hashes.append(words.hash(position, n)), second.append(words.second(position, n))
            doc.append(part.doc[row + first]), place.append(part.place(row + first, position - words.offsets[row]))
        return _sent(layout, [hashes, second], doc, place, True)

    found = repeats.answers(layout, repeats.visit(texts, None, quarters, repeats.TRAVEL), 1, False)
    found = repeats.answers(layout, repeats.visit(texts, found, halves, repeats.TRAVEL), 1, False)
    return repeats.answers(layout, repeats.visit(texts, found, wholes, repeats.TRAVEL), 2, True)


def _sent(layout: repeats.Layout, hashes: list[list[np.ndarray]], doc: list[np.ndarray], place: list[np.ndarray], later: bool) -> pa.Table:
    if not doc:
        return repeats.travel_table([])
    own = [np.concatenate(h) for h in hashes]
    return repeats.travel_table(list(repeats.requests(layout, own, np.concatenate(doc), np.concatenate(place), later)))


def dedup(docs: DataFrame, n: int = 50, keep_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if wanted, the kept words (joined by a space)."""
    layout = repeats.Layout(docs)
    texts = layout.texts(docs)
    fields = [texts.schema["doc_id"], StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept_sha256", StringType())]
    schema = StructType([*fields, *([StructField("kept", StringType())] if keep_text else [])])

    def kept(part: repeats.Part, rows: np.ndarray, at: np.ndarray) -> pa.Table:
        total, removed, digests, out = [], [], [], []
        order = np.argsort(rows, kind="stable")
        rows, at = rows[order], at[order]
        cuts = np.searchsorted(rows, np.arange(len(part.doc) + 1))
        for i in range(len(part.doc)):
            words = part.data[part.offsets[i] : part.offsets[i + 1]].tobytes().split()
            total.append(len(words))
            if cuts[i] < cuts[i + 1]:
                gone = np.zeros(len(words) + 1, np.int64)
                starts = np.unique(at[cuts[i] : cuts[i + 1]])
                np.add.at(gone, starts, 1), np.add.at(gone, starts + n, -1)
                words = [words[k] for k in np.flatnonzero(np.cumsum(gone[:-1]) == 0)]
            removed.append(total[-1] - len(words))
            left = b" ".join(words)
            digests.append(hashlib.sha256(left).hexdigest())
            if keep_text:
                out.append(left.decode())
        columns = [part.rows.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), *([pa.array(out, pa.string())] if keep_text else [])]
        return pa.Table.from_arrays(columns, names=schema.names)

    return repeats.visit(texts, covered(layout, texts, n), kept, schema)
