"""Packing documents into fixed-length sequences by their length histogram.

Documents become token ids; one longer than a sequence is cut into full pieces and a
rest.  Only the histogram of piece lengths (at most ``size`` numbers) reaches the driver.
Shortest-pack-first runs over it, longest lengths first: the pieces of a length go
to the packs with most room left, packs alike are handled together as a count, and a new
pack is opened only if none has room.  Each placement says which packs take the pieces
of ranks a to b of a length; pieces get a rank within their length (two levels: a random
range of the pieces of a length, then a row number inside) and look their placement up.

A pack costs padding up to ``size`` unless its length is a power of two.

Defined results: a null text is an empty one; an empty document is its end token alone;
a null id is an id like any other; equal rows are packed separately; an empty table gives
an empty result; further columns are ignored.
"""

from __future__ import annotations

import heapq
import itertools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from . import blocks, scratch

#: Rows of a random range of the pieces of one length.
RANGE = 250_000
#: Words whose ids a worker remembers, in flat arrays of some 40 bytes a word.
REMEMBERED = 800_000
#: Longest word that is remembered, in bytes; pieces of words that are; new words between two merges.
LONGEST, PIECES, NEW = 64, 50_000, 50_000

_WORKER: dict[str, "WordIds"] = {}


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where it is a
    visible Latin-1 character, else the next free code point from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in visible else next(rest)) for b in range(256)}


class _Table:
    """Ids of words in flat arrays, in order of a hash of the word; a second hash tells words apart."""

    def __init__(self):
        none = np.zeros(0, np.int64)
        self.keys, self.others, self.first, self.count, self.met, self.flat = none.view(np.uint64), none.view(np.uint64), none, none.astype(np.int32), none.astype(np.int32), np.zeros(0, np.uint32)

    def find(self, keys: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of each key, whether its word is here, whether another word holds its place)."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        taken = self.keys[at] == keys
        same = taken & (self.others[at] == others)
        return at, same, taken & ~same

    def add(self, keys: np.ndarray, others: np.ndarray, count: np.ndarray, met: np.ndarray, flat: np.ndarray) -> None:
        """Words whose keys ascend and are not here."""
        at = np.searchsorted(self.keys, keys)
        self.first = np.insert(self.first, at, len(self.flat) + np.cumsum(count) - count)
        self.flat = np.concatenate([self.flat, flat])
        self.keys, self.others, self.count, self.met = np.insert(self.keys, at, keys), np.insert(self.others, at, others), np.insert(self.count, at, count), np.insert(self.met, at, met)

    def ids(self, at: np.ndarray) -> np.ndarray:
        return self.flat[_spread(self.first[at], self.count[at].astype(np.int64))]

    def keep(self, at: np.ndarray) -> None:
        self.flat = self.ids(at)
        self.keys, self.others, self.count, self.met = self.keys[at], self.others[at], self.count[at], self.met[at]
        self.first = np.cumsum(self.count, dtype=np.int64) - self.count


class WordIds:
    """Token ids of texts, word by word.

    White space is never part of a token of the vocabulary and no rule of the tokenizer looks
    across it, so the ids of a text are those of its words, and most words were met before.
    The ids of words met lately lie in flat arrays, so a block of texts is looked up at once and
    the memory has a fixed bound.  The whole tokenizer takes tens of microseconds for a new word, its
    model alone a tenth of that.  Where the tokenizer only lower-cases, splits by a pattern and maps
    bytes, new words of plain Latin letters (for which lower case and composition are certain) are
    split here, all those of a block at once, and the model encodes the pieces.  Other words go
    through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        spec = json.loads(self.tokenizer.to_str())
        steps = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        split, *rest = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        simple = steps == ["NFC", "Replace", "Lowercase"] and split.get("type") == "Split" and split["behavior"] == "Removed" and split["invert"] and [(r["type"], r["add_prefix_space"], r["use_regex"]) for r in rest] == [("ByteLevel", False, False)]
        self.split = regex.compile(f"\\n|(?:{split['pattern']['Regex']})").findall if simple else None
        self.marks = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.plain = regex.compile("[\\x21-\\x7e\\u00a1-\\u024f]*").fullmatch
        self.letters = _byte_letters()
        self.known, self.new, self.now = _Table(), _Table(), 0
        self.pieces: dict[str, list[int]] = {}

    @classmethod
    def of_worker(cls, path: str) -> WordIds:
        """One for all tasks of a worker: what it holds is bounded, and words recur from task to task."""
        if path not in _WORKER:
            _WORKER[path] = cls(path)
        return _WORKER[path]

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each of some words."""
        texts = [w.decode() for w in words]
        joined = "\n".join(texts)
        if not self.split or any(m in joined for m in self.marks):
            return [self.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        plain = [self.plain(t) is not None for t in texts]
        out, own = [[] for _ in texts], iter([i for i, p in enumerate(plain) if p])
        for i, p in enumerate(plain):
            if not p:
                out[i] = self.tokenizer.encode(texts[i], add_special_tokens=False).ids
        here = out[next(own)] if any(plain) else None
        for piece in self.split("\n".join(t for t, p in zip(texts, plain) if p).lower()):
            if piece == "\n":
                here = out[next(own)]
                continue
            ids = self.pieces.get(piece)
            if ids is None:
                ids = [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))]
                if len(self.pieces) >= PIECES:
                    self.pieces.clear()
                if len(piece) <= LONGEST:
                    self.pieces[piece] = ids
            here += ids
        return out

    def _remember(self, keys: np.ndarray, others: np.ndarray, count: np.ndarray, flat: np.ndarray) -> None:
        """Add words (keys ascending and unknown); beyond the bound those not met for longest go."""
        self.new.add(keys, others, count.astype(np.int32), np.full(len(keys), self.now, np.int32), flat)
        if len(self.new.keys) > NEW:
            known, new = self.known, self.new
            if len(known.keys) + len(new.keys) > REMEMBERED:
                room = max(REMEMBERED // 2, REMEMBERED - 2 * len(new.keys))
                known.keep(np.sort(np.argsort(-known.met, kind="stable")[:room]))
            known.add(new.keys, new.others, new.count, new.met, new.ids(np.arange(len(new.keys))))
            self.new = _Table()

    def of(self, data: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts of a block, each with the end id after it; where each text begins and ends)."""
        start, stop, text = blocks.words(data, offsets)
        key, other = blocks.word_keys(data, start, stop)
        keys, sample, which = np.unique(key, return_index=True, return_inverse=True)
        alone = bool((other != other[sample][which]).any())
        if alone:  # two words of one hash: each for itself
            keys, sample, which = key, np.arange(len(key)), np.arange(len(key))
        others = other[sample]
        self.now += 1
        count, first, held = np.zeros(len(keys) + 1, np.int64), np.zeros(len(keys) + 1, np.int64), 0
        left, taken = np.ones(len(keys), bool), np.zeros(len(keys), bool)
        for table in (self.known, self.new):
            at, same, clash = table.find(keys, others)
            left, taken = left & ~same, taken | clash
            table.met[at[same]] = self.now
            count[:-1][same], first[:-1][same] = table.count[at[same]], table.first[at[same]] + held
            held += len(table.flat)
        fresh, raw = np.flatnonzero(left), data.tobytes()
        new = self.encode([raw[a:b] for a, b in zip(start[sample[fresh]].tolist(), stop[sample[fresh]].tolist())])
        n_new = np.fromiter(map(len, new), np.int64, len(new))
        flat_new = np.fromiter(itertools.chain.from_iterable(new), np.uint32, int(n_new.sum()))
        count[fresh], first[fresh] = n_new, held + np.cumsum(n_new) - n_new
        count[-1], first[-1] = 1, held + len(flat_new)  # the end id is a word of its own
        last = np.searchsorted(text, np.arange(len(offsets) - 1), "right")
        order = np.insert(which, last, len(keys))
        each = count[order]
        ids = np.concatenate([self.known.flat, self.new.flat, flat_new, np.array([end], np.uint32)])[_spread(first[order], each)]
        cuts = np.concatenate([[0], np.cumsum(each)])[np.concatenate([[0], last + np.arange(1, len(offsets))])]
        kept = ((stop - start)[sample[fresh]] <= LONGEST) & ~taken[fresh]
        if kept.any() and not alone:
            self._remember(keys[fresh][kept], others[fresh][kept], n_new[kept], flat_new[np.repeat(kept, n_new)])
        return ids, cuts


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Places of runs that begin at ``first``, end to end."""
    done = np.cumsum(count)
    return np.arange(int(done[-1]) if len(done) else 0) + np.repeat(first - (done - count), count)


def pieces(docs: DataFrame, tokenizer: str, end: int = 2, size: int = 4096, keep_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of each piece, and its ids if wanted."""
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = StructType([own.schema["doc_id"], *(StructField(c, LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens")), *([StructField("ids", BinaryType())] if keep_ids else [])])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds.of_worker(tokenizer)
        for batch, data, offsets in blocks.blocks(batches):
            found, cuts = words.of(data, offsets, end)
            total = np.diff(cuts)
            n = -(-total // size)
            row = np.repeat(np.arange(len(n)), n)
            start = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * size
            length = np.minimum(size, total[row] - start)
            low = cuts[row] + start
            raw = memoryview(found.astype("<u4", copy=False)).cast("B")
            ids = [raw[4 * a : 4 * b] for a, b in zip(low.tolist(), (low + length).tolist())]
            crc = np.fromiter(map(zlib.crc32, ids), np.int64, len(ids))
            columns = [batch.column("doc_id").take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total[row])), *([pa.array([bytes(x) for x in ids], pa.binary())] if keep_ids else [])]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return own.mapInArrow(blocks.frugal(cut), schema)


def shortest_pack_first(histogram: dict[int, int], size: int) -> dict[str, np.ndarray]:
    """Placements as arrays: length, rank (first of the pieces), pack (first), each (pieces of a
    pack, one after another), offset (of the first of them)."""
    room: dict[int, list[tuple[int, int]]] = {}  # room left: runs of packs (first, count)
    heap: list[int] = []
    out: list[tuple[int, int, int, int, int]] = []
    packs = 0

    def put(space: int, first: int, count: int) -> None:
        if space > 0 and count > 0:
            if space not in room:
                room[space] = []
                heapq.heappush(heap, -space)
            room[space].append((first, count))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            while heap and not room.get(-heap[0]):
                room.pop(-heapq.heappop(heap), None)
            if heap and -heap[0] >= length:
                space = -heap[0]
                first, count = room[space].pop()
                second = space if room[space] else max((s for s in room if s != space and room[s]), default=0)
                each = min(space // length, (space - second) // length + 1, max(1, left // count))
            else:
                space, first, each = size, packs, size // length
                count = -(-left // each)
                packs += count
            full = min(count, left // each)
            if full:
                out.append((length, rank, first, each, size - space))
                put(space - each * length, first, full)
            rank, left, first, count = rank + full * each, left - full * each, first + full, count - full
            if space == size and left:  # the last of the new packs is not filled by this length
                out.append((length, rank, first, each, 0))
                put(space - left * length, first, 1)
                count = left = 0
            put(space, first, count)
    names = ("length", "rank", "pack", "each", "offset")
    return {n: np.array(x, np.int64) for n, x in zip(names, zip(*out))} if out else {n: np.zeros(0, np.int64) for n in names}


def pack(cut: DataFrame, size: int = 4096) -> DataFrame:
    """Pieces (from ``pieces``, best stored) with their sequence_id and offset there."""
    spark = cut.sparkSession
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``size`` rows
    placed = spark.sparkContext.broadcast(shortest_pack_first(counts, size))
    ranges = spark.createDataFrame([(n, max(1, -(-c // RANGE))) for n, c in counts.items()], "length long, ranges long")
    dealt = cut.join(F.broadcast(ranges), "length").withColumn("range", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.col("ranges"))).drop("ranges")
    before = dealt.groupBy("length", "range").agg(F.count("*").alias("n"))
    before = before.select("length", "range", (F.sum("n").over(Window.partitionBy("length").orderBy("range")) - F.col("n")).alias("before"))
    row = F.row_number().over(Window.partitionBy("length", "range").orderBy("doc_id", "start", "ids_crc32")) - 1
    ranked = dealt.withColumn("row", row).join(before, ["length", "range"]).withColumn("rank", (F.col("before") + F.col("row")).cast("long")).drop("row", "before", "range")
    kept = [c for c in cut.columns if c != "length"]
    ranked = ranked.select(*kept, "length", "rank")
    schema = StructType([*(f for f in ranked.schema if f.name != "rank"), StructField("sequence_id", LongType()), StructField("offset", LongType())])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = placed.value
        order = np.lexsort((p["rank"], p["length"]))
        p = {k: v[order] for k, v in p.items()}
        wide = 1 << 48
        keys = p["length"] * wide + p["rank"]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(keys, length * wide + rank, side="right") - 1
            turn = rank - p["rank"][at]
            columns = [batch.column(c) for c in schema.names[:-2]]
            sequence = p["pack"][at] + turn // p["each"][at]
            offset = p["offset"][at] + turn % p["each"][at] * length
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], schema.names)

    return ranked.mapInArrow(blocks.frugal(look_up), schema)


def pack_documents(docs: DataFrame, tokenizer: str, end: int = 2, size: int = 4096, keep_ids: bool = True) -> DataFrame:
    """All documents of ``docs`` in sequences of at most ``size`` tokens, one row per piece."""
    return pack(scratch.table(pieces(docs, tokenizer, end, size, keep_ids), "pieces"), size)
