"""Near-dedup of embeddings with a forest of random-projection trees.

Vectors are compared within their label only, and equal vectors form classes first.  Every label
has trees of its own.  A tree splits at the median projection on the widest of a few random
directions, and a vector that lies within ``spill`` of the split goes to both sides: two vectors whose
cosine reaches the threshold part only if their projections differ by over twice the spill, 1.6
standard deviations, with the split between them, and then they still meet in other trees.

Splits are fitted on a bounded sample of a label's vectors, and all vectors go down the trees in chunks
of bounded size.  A leaf that is still large becomes a cell with a sample and a tree of its own, again and
again, until leaves are small or their vectors lie too close together to be parted.  So no leaf grows
with the data but those of true clumps, and the model of a cell never travels with its rows.

Vectors are compared within leaves by blocked products in double precision; a pair that meets in several
leaves counts in the first of them.  A clump is cut into blocks, and each pair of blocks is
compared on its own, so a large group of near copies is neither gathered nor paired up as rows:
a block pair returns numbers of links and a spanning forest of its links.

Defined results: vectors that are null, empty or zero or hold null or non-finite
components, and rows with null label or id, link with nothing; vectors of different lengths
do not link; rows with equal ids are one vertex but count as links of each other; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, LongType, StructField, StructType

from . import blocks, components, scratch

#: Trees of a label; vectors of a sample; vectors that a split is worth while for; vectors beyond
#: which a leaf is planted anew; vectors of a chunk; vectors of a block.
TREES, SAMPLE, LEAF, LARGE, CHUNK, BLOCK = 8, 4096, 24, 256, 20_000, 2000
#: Half the width around a split within which vectors go to both sides, in standard deviations of
#: the projected difference of two vectors at the threshold.
SPILL = 0.8


class Tree:
    """A tree as nested tuples (direction, split, below, above) with leaf numbers at the ends."""

    def __init__(self, points: np.ndarray, scale: float, spill: float, seed: int):
        """``scale``: how many vectors a point of the sample stands for."""
        self.spill, self.leaves, self.scale = spill, 0, scale
        self.random = np.random.default_rng(seed)
        self.root = self._grow(points)
        del self.random

    def _grow(self, points: np.ndarray):
        if len(points) * self.scale > LEAF and len(points) >= 8:
            choices = self.random.standard_normal((4, points.shape[1]))
            choices /= np.linalg.norm(choices, axis=1, keepdims=True)
            along = points @ choices.T
            best = int(np.argmax(along.std(0)))
            along, split = along[:, best], float(np.median(along[:, best]))
            below, above = points[along <= split + self.spill], points[along >= split - self.spill]
            if max(len(below), len(above)) <= 0.85 * len(points):
                return choices[best], split, self._grow(below), self._grow(above)
        self.leaves += 1
        return self.leaves - 1

    def of(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of unit vectors."""
        rows, leaves = [], []

        def go(node, own: np.ndarray) -> None:
            if isinstance(node, int):
                rows.append(own), leaves.append(np.full(len(own), node, np.int64))
            elif len(own):
                along = points[own] @ node[0]
                go(node[2], own[along <= node[1] + self.spill])
                go(node[3], own[along >= node[1] - self.spill])

        go(self.root, np.arange(len(points)))
        return np.concatenate(rows), np.concatenate(leaves)


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Unit vectors in double precision, one row each."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = pa.chunked_array(whole.chunks if isinstance(whole, pa.ChunkedArray) else [whole])
    x = np.concatenate([np.zeros(0), *(c.flatten().to_numpy(zero_copy_only=False) for c in flat.chunks)]).reshape(-1, dim)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable vectors with their class, classes: label, vector, rep, copies, and cid, a number that is fixed once it is stored)."""
    vector = F.col("embedding").cast("array<double>")
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    own = vectors.where(usable).select("vec_id", F.col("label").cast("string").alias("label"), vector.alias("vector")).where(fine)
    own = scratch.table(own.select("vec_id", "label", "vector", F.md5(F.array_join(F.transform("vector", lambda x: x.cast("string")), ",")).alias("hash")), "vectors")
    classes = scratch.table(own.groupBy("label", "hash").agg(F.min("vec_id").cast("long").alias("rep"), F.count("*").alias("copies"), F.first("vector").alias("vector")).withColumn("cid", F.monotonically_increasing_id()), "classes")
    return own.select("vec_id", "label", "hash").distinct(), classes


def _planted(rows: DataFrame, trees: int, dim: int, spill: float, seed: int) -> DataFrame:
    """(cell, cid, solid): leaves that vectors (cell, cid, vector) reach in ``trees`` trees of their cell; ``solid``
    where the cell was not split."""
    sizes = rows.groupBy("cell").agg(F.count("*").alias("n"))
    chunk = F.pmod(F.xxhash64("cid"), F.ceil(F.col("n") / CHUNK)).cast("int")
    dealt = rows.join(sizes, "cell").withColumn("chunk", chunk)
    # a hash of the id decides who is in the sample: SAMPLE of each cell, give or take its root
    lot = F.shiftrightunsigned(F.xxhash64("cid", F.lit(seed)), 11) / F.lit(float(1 << 53))
    sample = dealt.where(lot * F.col("n") < SAMPLE)
    fitted = StructType([StructField("cell", LongType()), StructField("trees", BinaryType())])

    def fit(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("cid")
        points = _matrix(table.column("vector"), dim)
        cell, n = table.column("cell")[0].as_py(), table.column("n")[0].as_py()
        grown = [Tree(points, n / len(points), spill, hash((cell, seed, t)) & 0x7FFFFFFF) for t in range(trees)]
        return pa.table({"cell": pa.array([cell]), "trees": pa.array([pickle.dumps(grown)], pa.binary())})

    fits = scratch.table(sample.select("cell", "cid", "n", "vector").groupBy("cell").applyInArrow(fit, fitted), "trees")
    models = fits.join(sizes, "cell").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / CHUNK).cast("int") - 1)))
    found = StructType([StructField("cell", LongType()), StructField("cid", LongType()), StructField("solid", BooleanType())])

    def plant(table: pa.Table, model: pa.Table) -> pa.Table:
        cells, cids, solid = [], [], []
        if table.num_rows:
            points, cid, cell = _matrix(table.column("vector"), dim), table.column("cid").to_numpy(), np.uint64(table.column("cell")[0].as_py() & (1 << 64) - 1)
            grown = pickle.loads(model.column("trees")[0].as_py()) if model.num_rows else [None]
            for t, tree in enumerate(grown):
                row, leaf = tree.of(points) if tree else (np.arange(len(cid)), np.zeros(len(cid), np.int64))
                number = leaf.astype(np.uint64) * np.uint64(TREES) + np.uint64(t + 1)
                cells.append(blocks.mix(blocks.mix(number) ^ cell).view(np.int64)), cids.append(cid[row]), solid.append(np.full(len(row), not tree or tree.leaves < 2))
        empty = np.zeros(0, np.int64)
        return pa.table({"cell": pa.array(np.concatenate(cells) if cells else empty), "cid": pa.array(np.concatenate(cids) if cids else empty), "solid": pa.array(np.concatenate(solid) if solid else empty.astype(bool))})

    left = dealt.select("cell", "chunk", "cid", "vector").groupBy("cell", "chunk")
    out = scratch.table(left.cogroup(models.select("cell", "chunk", "trees").groupBy("cell", "chunk")).applyInArrow(plant, found), "planted")
    scratch.free(fits)
    return out


def leaves(vectors: DataFrame, dim: int, spill: float, most_rounds: int = 40) -> DataFrame:
    """(cell, cid): leaves of vectors (label, cid, vector) in all trees."""
    now, parts = _planted(vectors.select(F.xxhash64("label").alias("cell"), "cid", "vector"), TREES, dim, spill, 1), []
    for turn in range(2, most_rounds):
        large = now.groupBy("cell").agg(F.count("*").alias("n"), F.first("solid").alias("solid")).where(f"n > {LARGE} AND NOT solid").select("cell")
        if not large.count():
            break
        large = scratch.table(large, "large", scratch.few(vectors.sparkSession))
        parts.append(now.join(large, "cell", "left_anti").select("cell", "cid"))
        now = _planted(now.join(large, "cell", "left_semi").select("cell", "cid").join(vectors.select("cid", "vector"), "cid"), 1, dim, spill, turn)
    if not parts:
        return now.select("cell", "cid")  # a vector reaches a leaf once
    whole = now.select("cell", "cid")  # after the last round what is left is compared as it is
    for part in parts:
        whole = whole.unionByName(part)
    return scratch.table(whole, "leaves")


def links(classes: DataFrame, least: float, dim: int) -> tuple[DataFrame, DataFrame]:
    """((cid, n) numbers of vectors linked to a class, (a, b) links that span its component)."""
    own = classes.where(F.size("vector") == dim).select("cid", "label", "rep", "copies", "vector")
    radius = float(np.sqrt(2 * (1 - least)))
    at = leaves(own, dim, min(radius / 2, SPILL * radius / np.sqrt(dim)))
    every = at.groupBy("cid").agg(F.array_sort(F.collect_list("cell")).alias("every"))
    sizes = at.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1").select("cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    dealt = at.join(sizes, "cell").withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("cell", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "cid")
    dealt = dealt.join(own.select("cid", F.xxhash64(F.lit("label"), "label").alias("of"), "rep", "copies", "vector").join(every, "cid"), "cid")
    found = StructType([StructField(c, LongType()) for c in ("cid", "n", "rep", "to")])
    key = ("cell", "low", "high")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(c).to_numpy() for c in key]
            new = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
            cuts = [0, *new.tolist(), batch.num_rows]
            out = []
            for a, b in zip(cuts, cuts[1:]):
                this = tuple(c[a] for c in columns)
                if this != now and held:
                    out.append(compare(held))
                    held = []
                now = this
                held.append(batch.slice(a, b - a))
            yield from pa.concat_tables([*out, found_none]).combine_chunks().to_batches()
        if held:
            yield from compare(held).to_batches()

    arrow = pa.schema([(c, pa.int64()) for c in found.names])
    found_none = arrow.empty_table()

    def compare(held: list[pa.RecordBatch]) -> pa.Table:
        """Links within one leaf, or between two blocks of it, that no earlier leaf has seen."""
        table = pa.Table.from_batches(held).combine_chunks()
        x = _matrix(table.column("vector"), dim)
        cid, of, rep, copies, block = (table.column(c).to_numpy() for c in ("cid", "of", "rep", "copies", "block"))
        here, low, high = (table.column(c)[0].as_py() for c in key)
        lists = table.column("every").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        cells, owner = lists.flatten().to_numpy(), np.repeat(np.arange(len(rep)), lists.value_lengths().to_numpy())
        earlier = cells < here
        names, place = np.unique(cells[earlier], return_inverse=True)
        met = np.zeros((len(rep), max(1, len(names))), np.float32)
        met[owner[earlier], place] = 1
        n, linked = np.zeros(len(rep), np.int64), []
        for a in range(0, len(rep), 512):
            part = slice(a, a + 512)
            near = x[part] @ x.T >= least
            near[np.arange(near.shape[0]), np.arange(a, a + near.shape[0])] = False
            if low != high:
                near &= block[part][:, None] != block[None, :]
            near &= of[part][:, None] == of[None, :]  # cells go by a hash
            if not near.any():
                continue
            linked.append((a, np.packbits(near, axis=1)))
            near &= met[part] @ met.T == 0
            n[part] = near @ copies
        # least rep that each reaches within the block pair
        label = rep.copy()
        while linked:
            before = label.copy()
            for a, packed in linked:
                near = np.unpackbits(packed, axis=1, count=len(rep)).astype(bool)
                some = near.any(1)
                to = np.flatnonzero(some) + a
                label[to] = np.minimum(label[to], np.where(near[some], label[None, :], np.iinfo(np.int64).max).min(1))
            if (label == before).all():
                break
        keep = (n > 0) | (label != rep)
        return pa.table({"cid": pa.array(cid[keep]), "n": pa.array(n[keep]), "rep": pa.array(rep[keep]), "to": pa.array(label[keep])}, schema=arrow)

    tasks = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = dealt.repartition(tasks, *key).sortWithinPartitions(*key).mapInArrow(blocks.frugal(run), found)
    out = scratch.table(out, "links")
    return out.groupBy("cid").agg(F.sum("n").alias("n")), out.where("rep != to").select(F.col("rep").alias("a"), F.col("to").alias("b")).distinct()


def near_duplicates(vectors: DataFrame, least: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id (least id reachable over links, its own included), kept.

    ``vectors``: vec_id, embedding, label.
    """
    members, classes = _classes(vectors)
    edges = [members.join(classes.select("label", "hash", "rep"), ["label", "hash"]).where("vec_id != rep").select(F.col("rep").alias("a"), F.col("vec_id").cast("long").alias("b"))]
    degrees = [classes.select("cid", F.lit(0).cast("long").alias("n")).limit(0)]
    for dim in sorted(r[0] for r in classes.select(F.size("vector")).distinct().collect()):  # one row per length in use
        n, some = links(classes, least, dim)
        degrees.append(n), edges.append(some)
    all_edges, all_degrees = edges[0], degrees[0]
    for e, d in zip(edges[1:], degrees[1:]):
        all_edges, all_degrees = all_edges.unionByName(e), all_degrees.unionByName(d)
    found = components.components(all_edges)
    by_class = classes.select("label", "hash", "cid", (F.col("copies") - 1).alias("same")).join(all_degrees, "cid", "left")
    own = members.join(by_class.select("label", "hash", (F.col("same") + F.coalesce("n", F.lit(0))).alias("n_links")), ["label", "hash"]).select("vec_id", "label", "hash", "n_links")
    vector = F.col("embedding").cast("array<double>")
    rows = vectors.select("vec_id", F.col("label").cast("string").alias("label"), F.md5(F.array_join(F.transform(vector, lambda x: x.cast("string")), ",")).alias("hash"))
    rows = rows.join(own, ["vec_id", "label", "hash"], "left").join(found.withColumnRenamed("id", "vec_id"), "vec_id", "left")
    component = F.coalesce("component", F.col("vec_id").cast("long"))
    return rows.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
