"""MinHash near-dedup with SetSketch registers.

A document is the set of its distinct word shingles.  Register ``i`` of its sketch is
``floor(1 - log_b(h))`` of the least of exponentially distributed hashes ``h`` of its
shingles, truncated to 16 bits: exponentially spaced, so registers of a union are maxima of
registers, and equal with a probability near the Jaccard similarity for ``b`` near 1.

1. Documents with equal sets form classes; one of each is sketched further.
2. Bands of registers are hashed; documents that share a band are candidates.  A document that
   shares bands with many is central.  Each document is compared with the most central
   one of each of its bands, best joint estimate first: a star, not all pairs.
3. The joint estimate is the maximum of the likelihood of (registers greater, less, equal)
   given both set sizes; pairs that fall clearly below the threshold are dropped.
4. The others are verified on the full sets of shingles: the text of one travels once to
   each part that holds partners of it.
5. Links make components.  Documents of different components that share a band are then
   estimated too, in blocks of sketches (a band with many documents is cut into blocks, each
   pair of blocks a task), and what may reach the threshold is verified, so no link is lost
   to the choice of the centre, and no pair leaves a block that is not likely a link.

With bands of 4 registers, 32 of them, two documents of similarity 0.8 share no band with
probability 4e-8.

Defined results: null, empty and blank texts have the empty set and link with nothing; a
text with fewer words than a shingle is one shingle; rows with a null id link with nothing
and are kept; rows with equal ids are one vertex; an empty table gives an empty result;
further columns are ignored.  Ids are integers (others are refused).
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from . import blocks, components, repeats, scratch

BANDS, ROWS = 32, 4
REGISTERS = BANDS * ROWS
#: Base and rate of the registers.
B, A = 1.001, 20.0
#: A pair is verified if its estimate is at most this much below the threshold: four standard
#: deviations of an estimate from 128 registers at 0.8.
SLACK = 0.14
#: Documents of a band that are compared at a time, and pairs that are estimated at a time.
BLOCK, PAIRS = 1500, 8192


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of the distinct shingles of each text of a block, in order of text and hash."""
    data = blocks.LOWER[data]
    start, end, text = blocks.words(data, offsets)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    sums = blocks.prefix(blocks.word_hashes(data, start, end))
    n = np.bincount(text, minlength=len(offsets) - 1)
    at = np.arange(len(start))
    first = (np.cumsum(n) - n)[text]
    long = n[text]
    begin = at[(at - first + size <= long) | ((at == first) & (long < size))]
    length = np.minimum(size, long[begin])
    found = blocks.mix(blocks.span(sums, begin, begin + length) + length.astype(np.uint64))
    own = text[begin]
    order = np.lexsort((found, own))
    found, own = found[order], own[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (own[1:] != own[:-1])
    return found[new], own[new]


def registers(found: np.ndarray, first: np.ndarray) -> np.ndarray:
    """SetSketch registers, one row for each set; ``first``: where sets begin in ``found``."""
    low, high = found.astype(np.uint32), (found >> np.uint64(32)).astype(np.uint32)
    seeds = blocks.mix(np.arange(1, 2 * REGISTERS + 1, dtype=np.uint64))
    out = np.empty((REGISTERS, len(first)), np.uint32)
    for i in range(REGISTERS):
        h = (low ^ np.uint32(seeds[2 * i] & np.uint64(0xFFFFFFFF))) * np.uint32(seeds[2 * i + 1] & np.uint64(0xFFFFFFFF) | np.uint64(1))
        h ^= h >> np.uint32(15)
        h += high
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(13)
        out[i] = np.minimum.reduceat(h, first)
    uniform = (out.astype(np.float64) + 0.5) / 2.0**32
    level = np.floor(1 - np.log(-np.log1p(-uniform) / A) / np.log(B))
    # truncated to 16 bits around the levels of sets of one to some 2 ** 60 elements
    return np.clip(level + 8192, 0, 65535).astype(np.uint16).T


def bands(sketch: np.ndarray) -> np.ndarray:
    """Hash of each band of each row of registers."""
    own = sketch.reshape(len(sketch), BANDS, ROWS).astype(np.uint64)
    out = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), own.shape[:2]).copy()
    for r in range(ROWS):
        out = blocks.mix(out * np.uint64(65537) + own[:, :, r])
    return out


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity of pairs by maximum likelihood on a grid, given both set sizes."""
    more, less = (a > b).sum(1), (a < b).sum(1)
    equal = a.shape[1] - more - less
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    best, at = np.full(len(a), -np.inf), np.zeros(len(a))
    chance = lambda x: -np.log1p(-np.clip(x, 1e-9, 1) * (B - 1) / B) / np.log(B)
    for j in np.linspace(0.0, 1.0, 51):
        j = np.minimum(j, np.minimum(u / v, v / u))
        p, q = chance(v * 0 + u - v * j), chance(v - u * j)
        score = more * np.log(p) + less * np.log(q) + equal * np.log(np.maximum(1 - p - q, 1e-12))
        at, best = np.where(score > best, j, at), np.maximum(score, best)
    return at


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """doc, n, two hashes of the whole set, and the sketch (null for the empty set)."""
    own = docs.select("doc_id", F.col("doc_id").cast("long").alias("doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    schema = StructType([own.schema["doc_id"], *(StructField(c, LongType()) for c in ("doc", "n", "k1", "k2")), StructField("sketch", BinaryType())])

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in blocks.blocks(batches):
            found, text = shingles(data, offsets, size)
            n = np.bincount(text, minlength=batch.num_rows)
            full = np.flatnonzero(n)
            first = (np.cumsum(n) - n)[full]
            k1, k2, rows = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64), np.full(len(n), None, object)
            if len(full):
                k1[full], k2[full] = np.add.reduceat(found, first), np.add.reduceat(blocks.mix(found + np.uint64(1)), first)
                rows[full] = [x.tobytes() for x in registers(found, first)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("doc"), pa.array(n.astype(np.int64)), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(rows, pa.binary())], schema.names)

    return own.mapInArrow(blocks.frugal(sketched), schema)


def _banded(reps: DataFrame) -> DataFrame:
    """(band, i, doc) of each sketch: hash and number of its bands."""

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint16).reshape(-1, REGISTERS)
                flat = pa.array(bands(sketch).view(np.int64).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BANDS), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([batch.column("doc"), lists], ["doc", "bands"])

    schema = StructType([StructField("doc", LongType()), StructField("bands", ArrayType(LongType()))])
    return reps.select("doc", "sketch").mapInArrow(blocks.frugal(banded), schema).select("doc", F.posexplode("bands").alias("i", "band"))


def _estimated(pairs: DataFrame, reps: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) that may reach ``least``, with their estimate."""
    a = reps.select(F.col("doc").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("s_a"))
    b = reps.select(F.col("doc").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("s_b"))
    both = pairs.join(a, "a").join(b, "b").where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * (100 * least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("s_a", "s_b"))
                guess = estimate(x, y, *(batch.column(c).to_numpy().astype(float) for c in ("n_a", "n_b")))
                keep = pa.array(guess >= least - SLACK)
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array((guess * 1000).astype(np.int32))], ["a", "b", "guess"]).filter(keep)

    return both.select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(blocks.frugal(run), StructType([StructField("a", LongType()), StructField("b", LongType()), StructField("guess", IntegerType())]))


#: Columns of a packed pair: its ends a and b, and the component that a stands for.
PAIR = [8, 8, 8]


def _by_part(layout: repeats.Layout, columns: list[np.ndarray]) -> pa.Table:
    """Pairs (a, b, to) packed for the parts of a."""
    rows = list(repeats.dealt(0, repeats.parts_of(columns[0].view(np.int64), layout.parts), columns, PAIR))
    return pa.table({"part": pa.array([r[0] for r in rows], pa.int32()), "packed": pa.array([r[2] for r in rows], pa.binary())})


#: Packed pairs that go to a part.
DEALT = StructType([StructField("part", IntegerType()), StructField("packed", BinaryType())])


def _dealt(layout: repeats.Layout, pairs: DataFrame) -> DataFrame:
    """Pairs (a, b, to) dealt to the parts of a: one row for each part and task."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            held.append([batch.column(c).to_numpy().view(np.uint64) for c in ("a", "b", "to")])
            if sum(len(h[0]) for h in held) > 1_000_000:
                yield from _by_part(layout, [np.concatenate(c) for c in zip(*held)]).to_batches()
                held = []
        if held:
            yield from _by_part(layout, [np.concatenate(c) for c in zip(*held)]).to_batches()

    return pairs.mapInArrow(blocks.frugal(deal), DEALT)


def verified(layout: repeats.Layout, texts: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """Of the pairs (a, b, to), dealt to parts, links (a, b) with 100 * intersection >= percent * union on full sets.

    The texts that one part has for another travel as one row.  ``to`` names what a stands
    for: a document that is linked to it once is not compared with it again.
    """
    sent = StructType([StructField("part", IntegerType()), StructField("packed", BinaryType())])

    def send(table: pa.Table, wanted: pa.Table) -> pa.Table:
        out = []
        blocks.give_back()
        if wanted.num_rows:
            part = repeats.Part(table)
            a, b, to = repeats.unpack(wanted.column("packed").to_pylist(), PAIR)
            order, dests = repeats.runs(repeats.parts_of(b.view(np.int64), layout.parts))
            for dest, x, y in dests:
                own = order[x:y]
                names, which = np.unique(a[own].view(np.int64), return_inverse=True)
                first, last = np.searchsorted(part.doc, names, "left"), np.searchsorted(part.doc, names, "right")
                texts_ = [[part.data[part.offsets[r] : part.offsets[r + 1]].tobytes() for r in range(f, e)] for f, e in zip(first, last)]
                out.append((dest, pickle.dumps((names, which, b[own].view(np.int64), to[own].view(np.int64), zstandard.ZstdCompressor(3).compress(pickle.dumps(texts_))))))
        return pa.table({"part": pa.array([r[0] for r in out], pa.int32()), "packed": pa.array([r[1] for r in out], pa.binary())})

    def whole_set(raw: np.ndarray) -> np.ndarray:
        return shingles(raw, np.array([0, len(raw)]), size)[0]

    def check(table: pa.Table, came: pa.Table) -> pa.Table:
        out = []
        blocks.give_back()
        if came.num_rows:
            part, own, done = repeats.Part(table), {}, set()
            for packed in came.column("packed").to_pylist():
                names, which, bs, tos, raw = pickle.loads(packed)
                others = [[whole_set(np.frombuffer(t, np.uint8)) for t in texts_] for texts_ in pickle.loads(zstandard.ZstdDecompressor().decompress(raw))]
                for w, b, to in zip(which.tolist(), bs.tolist(), tos.tolist()):
                    if (b, to) in done:
                        continue
                    if b not in own:
                        own[b] = [whole_set(part.data[part.offsets[r] : part.offsets[r + 1]]) for r in range(*np.searchsorted(part.doc, [b, b + 1]))]
                    if any(_alike(x, y, percent) for x in others[w] for y in own[b]):
                        done.add((b, to))
                        out.append((int(names[w]), b))
        a, b = zip(*out) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    moved = texts.groupBy("part").cogroup(pairs.groupBy("part")).applyInArrow(send, sent)
    return texts.groupBy("part").cogroup(moved.groupBy("part")).applyInArrow(check, StructType([StructField("a", LongType()), StructField("b", LongType())]))


def _alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union of two sorted sets, neither empty."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(x) + len(y) - both)


def _across(layout: repeats.Layout, left: DataFrame, least: float) -> DataFrame:
    """Pairs of different components in a band that may reach ``least``, each in its first band, packed.

    ``left``: band, i, doc, component, n, sketch.  A pair (a, b) has b outside the largest component
    of the band, and comes with the component of a.
    """
    sizes = left.groupBy("band").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = left.join(sizes, "band").withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("band", "i", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "doc", "component", "n", "sketch")

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        doc, component, n, block = (table.column(c).to_numpy() for c in ("doc", "component", "n", "block"))
        low, high, here = (table.column(c)[0].as_py() for c in ("low", "high", "i"))
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint16).reshape(-1, REGISTERS)
        names, inverse, times = np.unique(component, return_inverse=True, return_counts=True)
        outside = inverse != np.argmax(times)  # pairs within the largest component need no look
        out, held, size = [], [], 0

        def judged() -> None:
            """Estimates of the pairs held so far, all at once."""
            x, y = (np.concatenate(c) for c in zip(*held))
            likely = estimate(sketch[y], sketch[x], n[y].astype(float), n[x].astype(float)) >= least - SLACK
            out.append(np.stack([doc[y[likely]], doc[x[likely]], component[y[likely]]]))

        for x in np.flatnonzero(outside):
            own = (component != component[x]) & (~outside | (np.arange(len(doc)) > x)) & (100 * np.minimum(n, n[x]) >= 100 * least * np.maximum(n, n[x]))
            own &= block != block[x] if low != high else True
            y = np.flatnonzero(own)
            same = sketch[y] == sketch[x]
            near = np.flatnonzero(same.sum(1) >= REGISTERS * (least - 2 * SLACK))
            near = near[same[near].reshape(len(near), BANDS, ROWS).all(2).argmax(1) == here]
            if len(near):
                held.append((np.full(len(near), x), y[near]))
                size += len(near)
            if size > PAIRS:
                judged()
                held, size = [], 0
        if held:
            judged()
        pairs = np.concatenate(out, axis=1) if out else np.zeros((3, 0), np.int64)
        return _by_part(layout, [c.view(np.uint64) for c in pairs])

    # small in bytes but not in work: as many tasks as there are parts
    return dealt.repartition(layout.parts, "band", "low", "high").groupBy("band", "low", "high").applyInArrow(compare, DEALT)


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (least id reachable over links, its own included), kept."""
    layout, few = repeats.Layout(docs), scratch.few(docs.sparkSession)
    texts = layout.texts(docs.where(F.col("doc_id").isNotNull()))
    all_ = scratch.table(sketches(docs, size), "sketches")
    linked = all_.where(F.col("doc").isNotNull() & (F.col("n") > 0))
    heads = linked.groupBy("n", "k1", "k2").agg(F.min("doc").alias("rep"))
    classes = scratch.table(linked.select("doc", "n", "k1", "k2").join(heads, ["n", "k1", "k2"]).select("doc", "n", "k1", "k2", "rep").distinct(), "classes")
    reps = scratch.table(linked.join(heads.withColumnRenamed("rep", "doc"), ["n", "k1", "k2", "doc"]).select("doc", "n", "sketch").distinct(), "reps")

    rows = _banded(reps)
    many = rows.groupBy("band").agg(F.count("*").alias("times")).where("times > 1")
    shared = scratch.table(rows.join(many, "band"), "shared")
    central = scratch.table(shared.groupBy("doc").agg(F.sum("times").alias("central")), "central", few)
    ranked = shared.join(central, "doc").select("band", "doc", F.struct("central", (-F.col("doc")).alias("last"), "doc").alias("rank"))
    centres = ranked.groupBy("band").agg(F.max("rank").alias("centre"))
    pairs = ranked.join(centres, "band").where(F.col("rank") != F.col("centre"))
    pairs = pairs.select(F.col("centre.doc").alias("a"), F.col("doc").alias("b")).distinct()
    near = _estimated(pairs, reps, percent / 100)
    best = scratch.table(near.groupBy("b").agg(F.max_by("a", F.struct("guess", -F.col("a"))).alias("a")).select("a", "b"), "best")
    up = scratch.table(verified(layout, texts, _dealt(layout, best.select("a", "b", F.col("a").alias("to"))), size, percent), "up")

    # a document has one link up, to a more central one: two jumps name most components
    label = up.select(F.col("b").alias("doc"), F.col("a").alias("component"))
    for _ in range(2):
        higher = label.select(F.col("doc").alias("component"), F.col("component").alias("next"))
        label = label.join(higher, "component", "left").select("doc", F.coalesce("next", "component").alias("component"))
    label = scratch.table(label, "label", few)
    named = shared.select("band", "i", "doc").join(label, "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    mixed = named.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("band")
    across = _across(layout, named.join(mixed, "band").join(reps, "doc"), percent / 100)
    more = verified(layout, texts, across, size, percent)
    # rows with one id and different sets: their classes belong together
    twice = classes.join(classes.groupBy("doc").agg(F.min("rep").alias("a")), "doc").where("rep != a").select("a", F.col("rep").alias("b"))
    chains = label.select("component").distinct().join(up.select(F.col("b").alias("component"), "a"), "component").select("a", F.col("component").alias("b"))
    ends = more.unionByName(twice)
    for end in ("a", "b"):
        to = label.select(F.col("doc").alias(end), F.col("component").alias(f"{end}_to"))
        ends = ends.join(to, end, "left").withColumn(end, F.coalesce(f"{end}_to", end)).drop(f"{end}_to")
    merged = components.components(ends.select("a", "b").unionByName(chains).where("a != b").distinct())
    # the least id of each component, over the labels that belong together
    tops = reps.select("doc").join(label, "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    tops = tops.join(merged.select(F.col("id").alias("component"), F.col("component").alias("merged")), "component", "left").select("doc", F.coalesce("merged", "component").alias("component"))
    tops = scratch.table(tops, "tops", few)
    scratch.free(shared, central, best, up, label, reps)
    least = tops.groupBy("component").agg(F.min("doc").alias("least"))
    final = tops.join(least, "component").select(F.col("doc").alias("rep"), F.col("least").alias("component"))

    answer = classes.groupBy("doc").agg(F.min("rep").alias("rep"))
    answer = answer.join(final, "rep", "left").select("doc", F.coalesce("component", "rep").alias("component_id"))
    out = all_.select("doc_id", "doc", F.col("n").alias("n_shingles")).join(answer, "doc", "left")
    component = F.coalesce("component_id", "doc")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc"), F.lit(True)).alias("kept"))
