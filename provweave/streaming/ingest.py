"""Incremental compaction of a stream of documents: each micro-batch grows the model by appends.

Every batch writes its own tables below ``<root>/batch=<id>`` and then a marker.  The model that a
batch starts from is the latest merged one (``<root>/model=<id>``, written after every MERGE batches) and
the marked batches since, so the plan of a batch does not grow with the stream.  A batch that
is run again finds its marker and does nothing, or overwrites what a failed run has left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..config import DEFAULT, ProvConfig
from ..operators.stable import passing, stable
from ..plans import codec

#: Batches after which their models are merged.
MERGE = 16
#: Tables of the model, and their keys.
GROWING = {"dict": "sid", "template": "tid"}


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def _done(spark: SparkSession, root: str, mark: str = "done") -> list[int]:
    """Batches, or merged models, that are complete."""
    where, fs = _fs(spark, root)
    if not fs.exists(where):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(where)]
    return sorted(int(n.removeprefix(f"{mark}=")) for n in names if n.startswith(f"{mark}="))


def load(spark: SparkSession, root: str, before: int | None = None, config: ProvConfig = DEFAULT) -> codec.Compressed | None:
    """Everything compacted so far (or before a batch), as one corpus; None if nothing is."""
    batches = [b for b in _done(spark, root) if before is None or b < before]
    if not batches:
        return None
    parts = [codec.Compressed.read(spark, f"{root}/batch={b}") for b in batches]
    return codec.Compressed(_union(parts, codec.TABLES), parts[0].config, max(p.depth for p in parts))


def _union(parts: list[codec.Compressed], names) -> dict[str, DataFrame]:
    tables = {t: parts[0].tables[t] for t in names}
    for p in parts[1:]:
        tables = {t: tables[t].unionByName(p.tables[t]) for t in names}
    return tables


def known_model(spark: SparkSession, root: str, before: int) -> codec.Compressed | None:
    """The model (its growing tables alone) of all batches before one; None if there are none."""
    merged = [m for m in _done(spark, root, "merged") if m < before][-1:]
    batches = [b for b in _done(spark, root) if b < before and b > (merged[0] if merged else -1)]
    parts = [codec.Compressed.read(spark, f"{root}/batch={b}") for b in batches]
    if merged:
        some = parts or [codec.Compressed.read(spark, f"{root}/batch={merged[0]}")]
        base = {t: spark.read.schema(some[0].tables[t].schema).parquet(f"{root}/model={merged[0]}/{t}") for t in GROWING}
        parts = [codec.Compressed(base, some[0].config, some[0].depth), *parts]
    return codec.Compressed(_union(parts, GROWING), parts[0].config, 0) if parts else None


def _mark(spark: SparkSession, path: str) -> None:
    where, fs = _fs(spark, path)
    fs.create(where, True).close()


@passing()
def compact_batch(batch: DataFrame, batch_id: int, root: str, config: ProvConfig = DEFAULT) -> None:
    """Compact one micro-batch (graph, body)."""
    spark = batch.sparkSession
    if batch_id in _done(spark, root):
        return
    known = known_model(spark, root, batch_id)
    made = codec.compress(stable(batch), config, known)
    if known is not None:  # only what is new belongs to this batch
        for name, key in GROWING.items():
            made.tables[name] = made.tables[name].join(known.tables[name].select(key).distinct(), key, "left_anti")
    made.write(f"{root}/batch={batch_id}", mode="overwrite")
    _mark(spark, f"{root}/done={batch_id}")
    since = [b for b in _done(spark, root) if b > max([-1, *_done(spark, root, "merged")])]
    if len(since) >= MERGE:
        whole = known_model(spark, root, batch_id + 1)
        for name in GROWING:
            whole.tables[name].write.mode("overwrite").parquet(f"{root}/model={batch_id}/{name}")
        _mark(spark, f"{root}/merged={batch_id}")


def start(stream: DataFrame, root: str, checkpoint: str, config: ProvConfig = DEFAULT, **trigger) -> StreamingQuery:
    """Compact a streaming DataFrame (graph, body) until stopped."""
    writer = stream.writeStream.foreachBatch(lambda df, i: compact_batch(df, i, root, config)).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
