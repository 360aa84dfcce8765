"""What repeats across documents: the parts shared by the substring operators.

Texts are dealt once into parts of a few megabytes by document id, and all passes over them
read that one exchange.  A pass emits requests (hash, document, position) and the answers come back
to the part of the document.  Requests and answers travel as packed columns, one row
per part and bucket, so a shuffle moves a few bytes a request and hardly any rows.  Parts and buckets
are as many as the bytes of the texts ask for, whatever the number of shuffle partitions.

A part answers by itself what it can: of the requests of one hash only one of the
smallest document leaves the part, so a string that a third of all documents hold costs
one request per part, not one per document.

``Sampler`` picks positions by content (minimizers): every stretch of ``n`` elements
contains a picked stretch of ``k``, picked wherever the same ``n`` elements stand.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, IntegralType, NullType, StructField, StructType

from . import blocks

LAST = (1 << 63) - 1
#: Ids from here on are reserved: they stand for a null id in part LAST - id, and count as equal.
NULLS = LAST - (1 << 31)
#: Rows that travel: bucket or part, what it is (0 a request, 1 an answer), packed columns.
TRAVEL = StructType([StructField("dest", IntegerType()), StructField("kind", IntegerType()), StructField("packed", BinaryType())])


#: Bytes of texts that a part holds, but for one longer text.
PART = 4 << 20


def parts_of(doc: np.ndarray, parts: int) -> np.ndarray:
    """Parts of documents; ``Layout.texts`` names the same."""
    own = doc.view(np.uint64)
    mixed = np.mod((own ^ (own >> np.uint64(15)) ^ (own >> np.uint64(31))).view(np.int64), parts)
    return np.where(doc >= NULLS, LAST - doc, mixed).astype(np.int32)


def rank(doc: np.ndarray) -> np.ndarray:
    """Ids as they compare: null ids are equal and last."""
    return np.minimum(doc, NULLS)


class Layout:
    """Parts of texts and buckets of hashes: their number follows the bytes of the texts, so that each
    fits a worker at any size of the input and rows that travel never outnumber what they carry.
    The texts are read once for it, so a table that is dear to compute is best stored before."""

    def __init__(self, docs: DataFrame):
        kind = docs.schema["doc_id"].dataType
        if not isinstance(kind, IntegralType | NullType):
            raise TypeError(f"doc_id must be an integer column, not {kind.simpleString()}")
        session = docs.sparkSession
        size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
        self.tasks = int(session.conf.get("spark.sql.shuffle.partitions"))
        self.parts = max(2 * session.sparkContext.defaultParallelism + 1, -(-size // PART))
        self.buckets = self.parts

    def bucket(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes >> np.uint64(32)) % np.uint64(self.buckets)).astype(np.int32)

    def texts(self, docs: DataFrame) -> DataFrame:
        """part, doc (its id, or a reserved one), doc_id, text; rows without an id are dealt by their text."""
        text, doc = F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("doc_id").cast("long")
        mixed = doc.bitwiseXOR(F.shiftrightunsigned(doc, 15)).bitwiseXOR(F.shiftrightunsigned(doc, 31))
        part = F.pmod(F.coalesce(mixed, F.xxhash64(text)), F.lit(self.parts)).cast("int")
        return docs.select(part.alias("part"), F.coalesce(doc, F.lit(LAST) - part).alias("doc"), "doc_id", text.alias("text"))


class Part:
    """The texts of one part, in order of id: bytes, offsets, ids and marks.

    Rows with one id and different texts get different marks, so that an answer finds its row.
    """

    def __init__(self, table: pa.Table):
        table = table.combine_chunks()
        order = np.argsort(table.column("doc").to_numpy(), kind="stable")
        self.rows = table.take(pa.array(order)).combine_chunks()
        self.doc = self.rows.column("doc").to_numpy()
        text = self.rows.column("text").cast(pa.large_binary()).combine_chunks()
        text = text.chunk(0) if isinstance(text, pa.ChunkedArray) and text.num_chunks else text
        if isinstance(text, pa.ChunkedArray):
            text = pa.array([], pa.large_binary())
        self.offsets = np.frombuffer(text.buffers()[1], np.int64)[: len(text) + 1].copy() if len(text) else np.zeros(1, np.int64)
        self.data = np.frombuffer(text.buffers()[2], np.uint8)[: self.offsets[-1]] if len(text) and self.offsets[-1] else np.zeros(0, np.uint8)
        self.mark = np.zeros(len(self.doc), np.uint64)
        again = np.zeros(len(self.doc), bool)
        again[1:] = self.doc[1:] == self.doc[:-1]
        again[:-1] |= again[1:].copy()
        for i in np.flatnonzero(again):
            own = self.data[self.offsets[i] : self.offsets[i + 1]]
            self.mark[i] = blocks.mix(blocks.prefix(own)[-1:])[0] & np.uint64(0xFFFFFF)

    def pieces(self, size: int = blocks.BLOCK) -> Iterator[tuple[int, int]]:
        """Runs of texts of about ``size`` bytes."""
        at = 0
        while at < len(self.doc):
            to = max(at + 1, int(np.searchsorted(self.offsets, self.offsets[at] + size, side="right")) - 1)
            yield at, min(to, len(self.doc))
            at = to

    def find(self, doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and positions that answers (document, marked position) mean; equal rows all get them."""
        rows, at = [], []
        mark, position = place >> np.uint64(40), (place & np.uint64((1 << 40) - 1)).astype(np.int64)
        first, last = np.searchsorted(self.doc, doc, "left"), np.searchsorted(self.doc, doc, "right")
        for shift in range(int((last - first).max(initial=0))):
            row = np.minimum(first + shift, len(self.doc) - 1)
            own = (first + shift < last) & (self.mark[row] == mark)
            rows.append(row[own]), at.append(position[own])
        return (np.concatenate(rows), np.concatenate(at)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def place(self, row: np.ndarray, position: np.ndarray) -> np.ndarray:
        return (self.mark[row] << np.uint64(40)) | position.astype(np.uint64)


#: Bit of a request's place that says that its answer is known already.
KNOWN = np.uint64(1 << 39)
#: Requests of one hash from which it is called frequent, and the bit of an answer's place that says so.
FREQUENT, OFTEN = 1000, np.uint64(1 << 38)

#: Bytes of a candidate's hash that travel.  A bucket holds requests for some megabytes of texts, whatever
#: the input's size, so hardly any meet by chance; those that do are sorted out by the next step.
SHORT = 4


def pack(columns: list[np.ndarray], widths: list[int]) -> bytes:
    """The low bytes of 64-bit columns as planes, so that leading zeros compress."""
    return b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(-1, 8).T[:w].tobytes() for c, w in zip(columns, widths))


def unpack(packed: list[bytes], widths: list[int], steps: int | None = None) -> list[np.ndarray]:
    """Columns of packed rows; ``steps``: the column that holds differences."""
    out: list[list[np.ndarray]] = [[] for _ in widths]
    for x in packed:
        planes = np.frombuffer(x, np.uint8).reshape(sum(widths), -1)
        at = 0
        for c, w in enumerate(widths):
            whole = np.zeros((planes.shape[1], 8), np.uint8)
            whole[:, :w] = planes[at : at + w].T
            column = whole.view(np.uint64).ravel()
            out[c].append(np.cumsum(column, dtype=np.uint64) if c == steps else column)
            at += w
    return [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in out]


def runs(dest: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """(order, [(value, first, end)]) of equal values."""
    order = np.argsort(dest, kind="stable")
    ordered = dest[order]
    cuts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])).tolist() if len(dest) else []
    return order, [(int(ordered[a]), a, b) for a, b in zip(cuts, [*cuts[1:], len(dest)])]


def dealt(kind: int, dest: np.ndarray, columns: list[np.ndarray], widths: list[int], steps: int | None = None) -> Iterator[tuple[int, int, bytes]]:
    """Rows to travel: the columns packed by destination; of ``steps``, an ascending one, the differences."""
    order, found = runs(dest)
    columns = [c[order] for c in columns]
    for value, a, b in found:
        yield value, kind, pack([np.diff(c[a:b], prepend=np.uint64(0)) if i == steps else c[a:b] for i, c in enumerate(columns)], widths)


def travel_table(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    dest, kind, packed = zip(*rows) if rows else ((), (), ())
    return pa.table({"dest": pa.array(dest, pa.int32()), "kind": pa.array(kind, pa.int32()), "packed": pa.array(packed, pa.binary())})


def groups(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(order, first entry of each group) of entries with equal keys."""
    order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys)
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    return order, np.flatnonzero(new)


def _widths(hashes: int) -> list[int]:
    """Bytes of a request's columns: one hash is a candidate's, two must be whole."""
    return [*([SHORT] if hashes == 1 else [8] * hashes), 8, 8]


def requests(layout: Layout, hashes: list[np.ndarray], doc: np.ndarray, place: np.ndarray, later: bool) -> Iterator[tuple[int, int, bytes]]:
    """Requests of a part, answered here as far as possible.

    ``later``: wanted are occurrences that also stand in a smaller document; otherwise all
    occurrences of what stands in two documents or more.
    """
    if not len(doc):
        return
    order, first = groups(hashes)
    doc, place, hashes = doc[order], place[order], [h[order] for h in hashes]
    sizes, own = np.diff(np.append(first, len(doc))), rank(doc)
    least = np.repeat(np.minimum.reduceat(own, first), sizes)
    if later:
        known = own > least
        sent = ~known
    else:
        known = np.repeat(np.maximum.reduceat(own, first), sizes) > least
        # one request for all occurrences here: it wakes the other parts; without a second document here all must be answered
        sent = np.where(known, np.isin(np.arange(len(doc)), first), True)
    if known.any():
        yield from dealt(1, parts_of(doc[known], layout.parts) + layout.buckets, [doc[known].view(np.uint64), place[known]], [8, 8])
    place = np.where(known & sent, place | KNOWN, place)
    # in the order of the documents again, so that their ids travel as small differences
    sent = np.flatnonzero(sent)
    sent = sent[np.argsort(order[sent], kind="stable")]
    yield from dealt(0, layout.bucket(hashes[0][sent]), [*(h[sent] for h in hashes), doc[sent].view(np.uint64), place[sent]], _widths(len(hashes)), len(hashes))


def answers(layout: Layout, sent: DataFrame, hashes: int, later: bool, mark_frequent: bool = False) -> DataFrame:
    """Resolve travelling requests; gives (part, packed) with the document and place of each hit."""

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(packed: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
            *own, doc, place = unpack(packed, _widths(hashes), hashes)
            doc = doc.view(np.int64)
            order, first = groups(own)
            doc, place = doc[order], place[order]
            sizes, ids = np.diff(np.append(first, len(doc))), rank(doc)
            least = np.repeat(np.minimum.reduceat(ids, first), sizes)
            hit = ids > least if later else np.repeat(np.maximum.reduceat(ids, first), sizes) > least
            asked = (place & KNOWN) == 0
            if mark_frequent:  # also said to parts that knew their answer
                often = np.repeat(sizes > FREQUENT, sizes)
                asked, place = asked | often, np.where(often, place | OFTEN, place)
            hit &= asked
            yield from dealt(1, parts_of(doc[hit], layout.parts), [doc[hit].view(np.uint64), place[hit]], [8, 8])

        def out(rows):
            table = travel_table(list(rows)).select(["dest", "packed"])
            return table.rename_columns(["part", "packed"]).combine_chunks().to_batches()

        held: list[bytes] = []
        bucket = None
        for batch in batches:
            passed = []
            for dest, kind, packed in zip(*(batch.column(c).to_pylist() for c in ("dest", "kind", "packed"))):
                if dest != bucket and held:
                    yield from out(solved(held))
                    held = []
                bucket = dest
                if kind:
                    passed.append((dest - layout.buckets, 1, packed))
                else:
                    held.append(packed)
            yield from out(passed)
        if held:
            yield from out(solved(held))

    dealt_out = sent.repartition(layout.tasks, "dest").sortWithinPartitions("dest")
    return dealt_out.mapInArrow(blocks.frugal(resolve), StructType([StructField("part", IntegerType()), StructField("packed", BinaryType())]))


def visit(texts: DataFrame, found: DataFrame | None, run: Callable, schema: StructType) -> DataFrame:
    """``run(part, rows, positions)`` for each part; the last two are what ``found`` answers."""

    def alone(table: pa.Table) -> pa.Table:
        try:
            return run(Part(table))
        finally:
            blocks.give_back()

    def answered(table: pa.Table, hits: pa.Table) -> pa.Table:
        try:
            part = Part(table)
            doc, place = unpack(hits.column("packed").to_pylist(), [8, 8])
            return run(part, *part.find(doc.view(np.int64), place))
        finally:
            blocks.give_back()

    if found is None:
        return texts.groupBy("part").applyInArrow(alone, schema)
    return texts.groupBy("part").cogroup(found.groupBy("part")).applyInArrow(answered, schema)


def least_of(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours."""
    have, out = 1, x
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


class Sampler:
    """Picked stretches of ``k`` of a run of elements, for windows of ``n``."""

    def __init__(self, sums: np.ndarray, offsets: np.ndarray, n: int, k: int):
        """``sums``: prefix hashes of the elements; ``offsets``: where texts begin and end."""
        size = len(sums) - 1
        self.starts = np.zeros(0, np.int64)
        self.owner = np.zeros(0, np.int64)
        self.picked = np.zeros(0, np.int64)
        if size < n:
            return
        at = np.arange(size - k + 1)
        self.hashes = blocks.mix(blocks.span(sums, at, at + k))
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        inside = text[: size - n + 1] == text[n - 1 :]
        self.starts = np.flatnonzero(inside)
        owners, step, bits = [], 1 << 22, np.uint64(24)
        for low in range(0, size - n + 1, step):
            high = min(low + step, size - n + 1) + n - k
            keys = ((self.hashes[low:high] >> bits) << bits) | np.arange(high - low, dtype=np.uint64)
            owners.append((least_of(keys, n - k + 1) & np.uint64((1 << 24) - 1)).astype(np.int64) + low)
        self.owner = np.concatenate(owners)[self.starts]
        self.picked = np.unique(self.owner)
