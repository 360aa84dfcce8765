"""Suffix-array dedup over bytes, with hash-compared suffixes.

Sorting the suffixes of all texts is out of reach, and only suffixes that share
``n`` bytes with one of another document matter.  So

1. of each ``n``-byte string a stretch of ``k`` bytes is picked by content (see
   ``repeats.Sampler``), and only stretches that two documents share are followed up;
2. the texts around a shared stretch are its surroundings.  Equal ones are one representative, of
   the smallest document, and its members, first within a part, then in the bucket of the
   stretch, to which representatives travel.  Around a frequent stretch each window travels to a
   bucket of its own instead, so that no bucket gathers what a large share of all documents hold;
3. the suffixes of representatives are sorted in a bottom-up mergesort, run by run of one stretch and
   distance to it (equal ``n``-byte strings have both in common).  Two
   suffixes are compared by the longest extension that they have in common, found by binary
   search over prefix polynomial hashes, and the byte after it: a logarithmic number of steps.
   All merges of one width run together as array operations;
4. neighbours in the sorted order that share ``n`` bytes are compared byte by byte, so a
   hash collision cannot remove anything.  Each class of equal strings has a least document; a
   representative loses its windows whose class has a smaller one, and a member, whose document is
   larger than its representative's, loses those too.  Parts and buckets sort alike; a part
   settles what it can by itself.

Defined results: null, empty and short texts have nothing removed; a null id counts as
the largest; rows with equal ids are not compared with each other; an empty table gives an
empty result; further columns are ignored.  Ids are integers (others are refused); the last 2 ** 31
longs are reserved.  What is left of a text need not be valid UTF-8.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

from . import blocks, repeats

#: Surroundings that are sorted at a time, unless one stretch has more.
SORTED = 20_000


class Suffixes:
    """Order of suffixes, by their first ``n`` bytes, over one buffer of bytes."""

    def __init__(self, data: np.ndarray, n: int):
        self.data, self.n = data, n
        self.sums = blocks.prefix(data)

    def _same(self, a: np.ndarray, b: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return blocks.span(self.sums, a, a + length) == blocks.span(self.sums, b, b + length)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Longest common extension of suffixes a and b, ``n`` at most."""
        out = np.full(len(a), self.n, np.int64)
        open_ = np.flatnonzero(~self._same(a, b, self.n))
        low, high = np.zeros(len(open_), np.int64), np.full(len(open_), self.n - 1, np.int64)
        a, b = a[open_], b[open_]
        for _ in range(int(self.n - 1).bit_length()):
            middle = (low + high + 1) // 2
            same = self._same(a, b, middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        out[open_] = low
        return out

    def below(self, a: np.ndarray, b: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Whether suffix a comes before b; ``ties`` says what holds for equal ones."""
        shared = self.common(a, b)
        equal = shared == self.n
        out = ties.copy()
        open_ = np.flatnonzero(~equal)
        out[open_] = self.data[a[open_] + shared[open_]] < self.data[b[open_] + shared[open_]]
        return out

    def mergesort(self, at: np.ndarray, run: np.ndarray) -> np.ndarray:
        """Suffixes ``at`` sorted within runs (``run``: ascending run number of each)."""
        at = at.copy()
        first = np.searchsorted(run, run, "left")
        last = np.searchsorted(run, run, "right")
        width, most = 1, int((last - first).max(initial=1))
        index = np.arange(len(at))
        while width < most:
            active = np.flatnonzero(last - first > width)
            own, begin, end = index[active] - first[active], first[active], last[active]
            left = (own // width) % 2 == 0
            pair = own // (2 * width) * 2 * width
            low = begin + pair + np.where(left, width, 0)
            high = np.minimum(low + width, end)
            low = np.minimum(low, end)
            start = low.copy()
            key = at[active]
            # how many of the sibling's suffixes come before: strictly for the left half, equal ones too for the right
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                middle = (low[open_] + high[open_]) // 2
                before = self.below(at[middle], key[open_], ~left[open_])
                low[open_] = np.where(before, middle + 1, low[open_])
                high[open_] = np.where(before, high[open_], middle)
            place = begin + pair + own % width + (low - start)
            merged = at.copy()
            merged[place] = key
            at = merged
            width *= 2
        return at

    def equal_bytes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the first ``n`` bytes of suffixes a and b are the same, byte by byte."""
        view = np.lib.stride_tricks.sliding_window_view(self.data, self.n)
        out = np.ones(len(a), bool)
        for low in range(0, len(a), 1 << 16):
            out[low : low + (1 << 16)] = (view[a[low : low + (1 << 16)]] == view[b[low : low + (1 << 16)]]).all(1)
        return out


#: Columns of travelling surroundings: stretch, its distance, document, place, size; then the bytes.
COLUMNS = [repeats.SHORT, 2, 8, 8, 4]


def _wrap(columns: list[np.ndarray], flat: np.ndarray) -> bytes:
    """Surroundings for one bucket: packed columns and compressed bytes."""
    head = repeats.pack(columns, COLUMNS)
    return len(columns[0]).to_bytes(4, "little") + head + zstandard.ZstdCompressor(3).compress(flat.tobytes())


def _unwrap(packed: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
    heads, texts, wide = [], [], sum(COLUMNS)
    for x in packed:
        end = 4 + wide * int.from_bytes(x[:4], "little")
        heads.append(x[4:end]), texts.append(zstandard.ZstdDecompressor().decompress(x[end:]))
    return repeats.unpack(heads, COLUMNS), np.frombuffer(b"".join(texts), np.uint8)


def _gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of many stretches, end to end, and their offsets."""
    offsets = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(offsets[-1], dtype=np.int32) + np.repeat((start - offsets[:-1]).astype(np.int32), size)
    return data[at], offsets


def _same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the stretches at a and b hold the same bytes."""
    out = np.ones(len(a), bool)
    for some in np.array_split(np.arange(len(a)), 1 + len(a) // 8192) if len(a) else ():
        x, cuts = _gather(data, a[some], size[some])
        wrong = np.concatenate([[0], np.cumsum(x != _gather(data, b[some], size[some])[0], dtype=np.int32)])
        out[some] = wrong[cuts[1:]] == wrong[cuts[:-1]]
    return out


def _members(data: np.ndarray, key: np.ndarray, doc: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The representative of each stretch of bytes: the one with the smallest document of its key if
    it holds the same bytes, byte by byte, and its document is smaller; else the stretch itself."""
    out = np.arange(len(doc))
    if not len(doc):
        return out
    order, begin = repeats.groups([key])
    group = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(order))))
    doc = repeats.rank(doc)
    smallest = np.flatnonzero(doc[order] == np.minimum.reduceat(doc[order], begin)[group])
    holder = np.zeros(len(begin), np.int64)
    holder[group[smallest][::-1]] = order[smallest][::-1]
    chief = np.empty(len(order), np.int64)
    chief[order] = holder[group]
    later = np.flatnonzero((doc > doc[chief]) & (size == size[chief]))
    later = later[_same_bytes(data, start[later], start[chief[later]], size[later])]
    out[later] = chief[later]
    return out


def _windows(part: repeats.Part, first: int, last: int, rows: np.ndarray, at: np.ndarray, often: np.ndarray, n: int, k: int) -> tuple[np.ndarray, ...]:
    """Runs of windows around the shared stretches of a run of texts: hash of the stretch, its
    distance, row, first byte in the part, number of windows, and hash of the whole run.

    Around stretches whose hashes are among ``often`` each window is a run of its own, with a hash of its own.
    """
    base = part.offsets[first]
    offsets, data = part.offsets[first : last + 1] - base, part.data[base : part.offsets[last]]
    own = (rows >= first) & (rows < last)
    none = tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64, np.int64, np.uint64))
    if not own.any():
        return none
    sums = blocks.prefix(data)
    found = repeats.Sampler(sums, offsets, n, k)
    shared = np.zeros(len(data) + 1, bool)
    shared[np.minimum(at[own] + offsets[rows[own] - first], len(data))] = True
    keep = shared[found.owner] if len(found.owner) else np.zeros(0, bool)
    starts, owner = found.starts[keep], found.owner[keep]
    if not len(starts):
        return none
    # the windows of one stretch are consecutive
    frequent = np.isin(found.hashes[owner], often)
    new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (starts[1:] != starts[:-1] + 1) | frequent[1:]]))
    low, anchor, windows = starts[new], owner[new], np.diff(np.append(new, len(starts)))
    row = np.searchsorted(offsets, low, "right") - 1 + first
    whole = blocks.mix(blocks.span(sums, low, low + windows + n - 1))
    return np.where(frequent[new], blocks.mix(found.hashes[anchor] ^ whole), found.hashes[anchor]), anchor - low, row, low + base, windows, whole


def _stretch_hashes(part: repeats.Part, rows: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Distinct hashes of the stretches of ``k`` bytes at some places."""
    out = []
    for first, last in part.pieces() if len(rows) else ():
        own = (rows >= first) & (rows < last)
        if own.any():
            base = part.offsets[first]
            place = part.offsets[rows[own]] - base + at[own]
            out.append(blocks.mix(blocks.span(blocks.prefix(part.data[base : part.offsets[last]]), place, place + k)))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


#: Columns of answers: document, place, windows.
SPAN = [8, 8, 4]


def _spans(doc: np.ndarray, place: np.ndarray, count: np.ndarray, parts: int) -> Iterator[tuple[int, int, bytes]]:
    """Answers: documents, places and how many windows in a row start there."""
    return repeats.dealt(1, repeats.parts_of(doc, parts), [doc.view(np.uint64), place, count.astype(np.uint64)], SPAN)


def surroundings(layout: repeats.Layout, texts: DataFrame, n: int, k: int) -> DataFrame:
    """Shared stretches with the texts around them; what a part can answer itself comes as packed answers."""

    def stretches(part: repeats.Part) -> pa.Table:
        hashes, doc, place = [], [], []
        for first, last in part.pieces():
            base = part.offsets[first]
            offsets = part.offsets[first : last + 1] - base
            found = repeats.Sampler(blocks.prefix(part.data[base : part.offsets[last]]), offsets, n, k)
            if len(found.picked):
                row = np.searchsorted(offsets, found.picked, "right") - 1
                hashes.append(found.hashes[found.picked]), doc.append(part.doc[row + first]), place.append(part.place(row + first, found.picked - offsets[row]))
        if not doc:
            return repeats.travel_table([])
        return repeats.travel_table(list(repeats.requests(layout, [np.concatenate(hashes)], np.concatenate(doc), np.concatenate(place), False)))

    def follow(part: repeats.Part, rows: np.ndarray, at: np.ndarray) -> pa.Table:
        often = (at & int(repeats.OFTEN)) != 0
        at = at & ~int(repeats.OFTEN | repeats.KNOWN)
        often = _stretch_hashes(part, rows[often], at[often], k)
        found = [_windows(part, first, last, rows, at, often, n, k) for first, last in part.pieces()] if len(rows) else []
        if not sum(len(f[0]) for f in found):
            return repeats.travel_table([])
        anchor, lead, row, low, windows, whole = (np.concatenate(c) for c in zip(*found))
        doc, place, size = part.doc[row], part.place(row, low - part.offsets[row]), windows + n - 1
        sent, spans = settle(part.data, anchor, lead, whole, doc, place, low, size, n)
        out = [(to + layout.buckets, 1, packed) for to, _, packed in _spans(*spans, layout.parts)]
        order, dests = repeats.runs(layout.bucket(anchor[sent]))
        sent = sent[order]
        columns = [anchor[sent], lead[sent].astype(np.uint64), doc[sent].view(np.uint64), place[sent], size[sent].astype(np.uint64)]
        out += [(to, 0, _wrap([c[a:b] for c in columns], _gather(part.data, low[sent[a:b]], size[sent[a:b]])[0])) for to, a, b in dests]
        return repeats.travel_table(out)

    found = repeats.answers(layout, repeats.visit(texts, None, stretches, repeats.TRAVEL), 1, False, mark_frequent=True)
    return repeats.visit(texts, found, follow, repeats.TRAVEL)


def _sorted_out(flat: np.ndarray, cuts: np.ndarray, anchor: np.ndarray, lead: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Least document of the class of each window of some surroundings, which lie end to end in ``flat``.

    The windows are sorted as suffixes; classes are runs of neighbours with the same ``n`` bytes.
    """
    windows = np.diff(cuts) - n + 1
    row = np.repeat(np.arange(len(doc)), windows)
    step = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = cuts[row] + step
    distance = lead[row] - step + n  # of the stretch from the window's start; n: leads are positive or 0
    order = np.lexsort((distance, anchor[row]))
    run = np.zeros(len(order), np.int64)
    if len(order):
        run[1:] = np.cumsum((anchor[row][order][1:] != anchor[row][order][:-1]) | (distance[order][1:] != distance[order][:-1]))
    suffixes = Suffixes(flat, n)
    # places in the buffer name the windows, so the sorted order needs no second array
    window_at = np.zeros(len(flat) + 1, np.int64)
    window_at[at] = np.arange(len(at))
    ordered = suffixes.mergesort(at[order], run)
    same = np.zeros(len(ordered), bool)
    if len(ordered) > 1:
        pairs = np.flatnonzero(run[1:] == run[:-1])
        pairs = pairs[suffixes.common(ordered[pairs], ordered[pairs + 1]) == n]
        same[pairs + 1] = suffixes.equal_bytes(ordered[pairs], ordered[pairs + 1])
    begin, which = np.flatnonzero(~same), window_at[ordered]
    out = np.zeros(len(ordered), np.int64)
    if len(ordered):
        own = repeats.rank(doc)[row[which]]
        out[which] = np.repeat(np.minimum.reduceat(own, begin), np.diff(np.append(begin, len(own))))
    return out


def settle(data: np.ndarray, anchor: np.ndarray, lead: np.ndarray, whole: np.ndarray, doc: np.ndarray, place: np.ndarray, start: np.ndarray, size: np.ndarray, n: int) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """(representatives among some surroundings, spans (document, place, windows) to remove).

    ``whole``: a hash of each whole surrounding.  Verdicts come from the sorted suffixes of
    representatives: a window goes where its class has a document smaller than the surrounding's.
    """
    chief = _members(data, whole ^ blocks.mix(anchor + lead.astype(np.uint64)), doc, start, size)
    heads = np.flatnonzero(chief == np.arange(len(doc)))
    followers = np.bincount(chief, minlength=len(doc))  # itself included
    heads = heads[np.argsort(anchor[heads], kind="stable")]
    first = np.flatnonzero(np.concatenate([[True], anchor[heads][1:] != anchor[heads][:-1]])) if len(heads) else np.zeros(0, np.int64)
    times = np.diff(np.append(first, len(heads)))
    # a stretch with one representative without members has no second occurrence
    busy = heads[np.repeat(np.add.reduceat(followers[heads], first) > 1, times)] if len(heads) else heads
    found: list[tuple[np.ndarray, ...]] = []
    beyond = np.full(len(doc), np.iinfo(np.int64).max)  # least document of the last class of a representative's windows
    at = 0
    while at < len(busy):
        to = min(at + SORTED, len(busy))
        while to < len(busy) and anchor[busy[to]] == anchor[busy[to - 1]]:
            to += 1
        some = busy[at:to]
        text, cuts = _gather(data, start[some], size[some])
        windows = size[some] - n + 1
        least = _sorted_out(text, cuts, anchor[some], lead[some], doc[some], n)
        begin = np.cumsum(windows) - windows
        row = np.repeat(np.arange(len(some)), windows)
        gone = np.flatnonzero(least < repeats.rank(doc[some])[row])
        if len(gone):
            new = np.flatnonzero(np.concatenate([[True], (gone[1:] != gone[:-1] + 1) | (row[gone[1:]] != row[gone[:-1]])]))
            r = some[row[gone[new]]]
            found.append((doc[r], place[r] + (gone[new] - begin[row[gone[new]]]).astype(np.uint64), np.diff(np.append(new, len(gone)))))
        beyond[some] = np.maximum.reduceat(least, begin) if len(some) else 0
        at = to
    # all windows of a member go if its document lies beyond the least one of each of their classes
    member = np.flatnonzero(chief != np.arange(len(doc)))
    member = member[repeats.rank(doc[member]) > beyond[chief[member]]]
    found.append((doc[member], place[member], size[member] - n + 1))
    return heads, tuple(np.concatenate(c) for c in zip(*found))


def sort_suffixes(layout: repeats.Layout, around: DataFrame, n: int) -> DataFrame:
    """(part, packed): documents, places and numbers of windows that start in a smaller document too."""

    def bucket(packed: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
        (anchor, lead, doc, place, size), flat = _unwrap(packed)
        size = size.astype(np.int64)
        start = np.cumsum(size) - size
        whole = blocks.mix(blocks.span(blocks.prefix(flat), start, start + size))
        _, spans = settle(flat, anchor, lead.astype(np.int64), whole, doc.view(np.int64), place, start, size, n)
        yield from _spans(*spans, layout.parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows) -> list[pa.RecordBatch]:
            rows = list(rows)
            return pa.table({"part": pa.array([r[0] for r in rows], pa.int32()), "packed": pa.array([r[2] for r in rows], pa.binary())}).to_batches()

        held: list[bytes] = []
        now = None
        for batch in batches:
            passed = []
            for dest, kind, packed in zip(*(batch.column(c).to_pylist() for c in ("dest", "kind", "packed"))):
                if dest != now and held:
                    yield from out(bucket(held))
                    held = []
                now = dest
                if kind:
                    passed.append((dest - layout.buckets, 1, packed))
                else:
                    held.append(packed)
            yield from out(passed)
        if held:
            yield from out(bucket(held))

    return around.repartition(layout.tasks, "dest").sortWithinPartitions("dest").mapInArrow(blocks.frugal(run), StructType([StructField("part", IntegerType()), StructField("packed", BinaryType())]))


def dedup(docs: DataFrame, n: int = 50, k: int = 24, keep_bytes: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if wanted, the remaining bytes."""
    layout = repeats.Layout(docs)
    texts = layout.texts(docs)
    found = sort_suffixes(layout, surroundings(layout, texts, n, k), n)
    fields = [texts.schema["doc_id"], *(StructField(c, LongType()) for c in ("n_bytes", "n_removed", "n_spans")), StructField("kept_sha256", StringType())]
    schema = StructType([*fields, *([StructField("kept", BinaryType())] if keep_bytes else [])])

    def kept(table: pa.Table, hits: pa.Table) -> pa.Table:
        try:
            return cleaned(repeats.Part(table), hits)
        finally:
            blocks.give_back()

    def cleaned(part: repeats.Part, hits: pa.Table) -> pa.Table:
        doc, place, count = repeats.unpack(hits.column("packed").to_pylist(), SPAN)
        # the number of windows rides along as a third position
        rows, at, times = _find_with(part, doc.view(np.int64), place, count.astype(np.int64))
        order = np.argsort(rows, kind="stable")
        rows, at, times = rows[order], at[order], times[order]
        cuts = np.searchsorted(rows, np.arange(len(part.doc) + 1))
        total, removed, spans, digests, out = np.diff(part.offsets), [], [], [], []
        for i in range(len(part.doc)):
            own = part.data[part.offsets[i] : part.offsets[i + 1]]
            removed.append(0), spans.append(0)
            if cuts[i] < cuts[i + 1]:
                marks = np.zeros(len(own) + 1, np.int64)
                here, many = at[cuts[i] : cuts[i + 1]], times[cuts[i] : cuts[i + 1]]
                np.add.at(marks, here, 1), np.add.at(marks, here + many - 1 + n, -1)
                gone = np.cumsum(marks[:-1]) > 0
                removed[-1] = int(gone.sum())
                spans[-1] = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
                own = own[~gone]
            raw = own.tobytes()
            digests.append(hashlib.sha256(raw).hexdigest())
            if keep_bytes:
                out.append(raw)
        columns = [part.rows.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string()), *([pa.array(out, pa.binary())] if keep_bytes else [])]
        return pa.Table.from_arrays(columns, names=schema.names)

    return texts.groupBy("part").cogroup(found.groupBy("part")).applyInArrow(kept, schema)


def _find_with(part: repeats.Part, doc: np.ndarray, place: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``Part.find`` with a number that goes with each answer."""
    rows, at, times = [], [], []
    for each in np.unique(count):
        own = count == each
        r, a = part.find(doc[own], place[own])
        rows.append(r), at.append(a), times.append(np.full(len(r), each))
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) if x else none for x in (rows, at, times))
