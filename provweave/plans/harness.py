"""Size and time of compressing corpora: one result per corpus, their pooled total, reports."""

from __future__ import annotations

import datetime
import json
import resource
import time
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.jsontext import prov_minified_len
from ..operators import stats
from ..sources import files
from ..sources.provjson import read_corpus
from . import codec, workspace


@dataclass
class Result:
    """Measures of one corpus."""

    corpus: str
    graphs: int
    input_bytes: int
    minified_bytes: int
    payload_bytes: int
    orig_nodes: int
    orig_edges: int
    total_supernodes: int
    dict_strings: int
    residual_nodes: int
    compress_s: float
    decompress_s: float
    peak_mb: float
    lossless: bool
    roundtrip_failures: int
    is_pooled: bool = False

    @property
    def reduction(self) -> float:
        return percent(self.payload_bytes, self.input_bytes)


def percent(compressed: float, original: float) -> float:
    return (1 - compressed / original) * 100 if original > 0 else 0.0


def folder_bytes(spark: SparkSession, folder: str) -> int:
    """Bytes of all files below a folder."""
    return sum(n for _, n in files.listed(spark, folder))


def payload_bytes(spark: SparkSession, folder: str) -> int:
    """Bytes of the model file and the views, not of logs and statistics."""
    return sum(n for p, n in files.listed(spark, folder) if p == codec.MODEL_FILE or p.startswith(f"{codec.VIEW_DIR}/"))


def peak_mb(spark: SparkSession) -> float:
    """Largest peak, in MB, of the driver's Python and of each JVM of the application with its Python
    workers, as far as Spark reports process trees (``spark.executor.processTreeMetrics.enabled``); heaps otherwise."""
    peaks = [resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024]
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    for i in range(executors.size()):
        found = executors.apply(i).peakMemoryMetrics()
        if found.isDefined():
            of = found.get().getMetricValue
            tree = sum(of(f"ProcessTree{k}RSSMemory") for k in ("JVM", "Python", "Other"))
            peaks.append(max(tree, of("JVMHeapMemory") + of("JVMOffHeapMemory")) / 1e6)
    return max(peaks)


def compare(corpus: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """State of each document of ``corpus`` against another corpus, both as they were read."""
    return stats.verify(corpus, rebuilt.select("graph", stats.prov_canonical("body").alias("text")))


def measure(spark: SparkSession, source: str, name: str, work: str | None = None) -> Result:
    """Compress with verification, decompress, compare once more; ``work`` is a folder that all executors share."""
    corpus = read_corpus(spark, source)
    sizes = corpus.agg(F.count("*").alias("n"), F.sum("n_bytes").alias("bytes"), F.sum(prov_minified_len("body")).alias("minified")).first()
    with workspace.folder(spark, work) as top:
        out, back = f"{top}/out", f"{top}/back"
        began = time.time()
        totals = codec.compress_directory(spark, source, out, verify=True)
        compressed = time.time()
        codec.decompress_directory(spark, out, back)
        restored = time.time()
        second = compare(corpus, read_corpus(spark, back))
        failures = stats.verify_summary(second).first()["failures"] + totals["roundtrip_failures"]
        payload = payload_bytes(spark, out)
    return Result(name, sizes["n"], sizes["bytes"] or 0, sizes["minified"] or 0, payload, totals["orig_nodes"], totals["orig_edges"], totals["total_supernodes"], totals["dict_strings"], totals["residual_nodes"],
                  compressed - began, restored - compressed, peak_mb(spark), failures == 0, failures)


def table(spark: SparkSession, results: list[Result]) -> DataFrame:
    """Results as a DataFrame, smallest input first."""
    return spark.createDataFrame([asdict(r) for r in results]).orderBy("input_bytes")


def pool(results: list[Result], name: str) -> Result:
    """Several corpora as one: sums, greatest memory, lossless only if all are."""
    add = lambda field: sum(getattr(r, field) for r in results)
    sums = ("graphs", "input_bytes", "minified_bytes", "payload_bytes", "orig_nodes", "orig_edges", "total_supernodes", "dict_strings", "residual_nodes", "compress_s", "decompress_s", "roundtrip_failures")
    return Result(name, peak_mb=max(r.peak_mb for r in results), lossless=all(r.lossless for r in results), is_pooled=True, **{f: add(f) for f in sums})


def save_json(spark: SparkSession, results: list[Result], folder: str, failed: list[str]) -> str:
    path = f"{folder}/benchmark_results.json"
    # Keys of the results file.
    whole = {"benchmark_date": datetime.datetime.now().isoformat(), "reduction_definition": "(1 - compressed/original) * 100", "complete": not failed, "failed_corpora": failed, "results": [asdict(r) | {"reduction": r.reduction} for r in results]}
    files.put_text(spark, path, json.dumps(whole, indent=2))
    return path


def _latex(caption: str, heads: list[str], rows: list[list[str]]) -> str:
    body = " \\\\\n".join(" & ".join(r) for r in [heads, *rows])
    return f"\\begin{{table}}\n\\caption{{{caption}}}\n\\begin{{tabular}}{{l{'r' * (len(heads) - 1)}}}\n{body} \\\\\n\\end{{tabular}}\n\\end{{table}}\n"


def save_latex(spark: SparkSession, results: list[Result], folder: str) -> str:
    """Two tables: sizes and times, smallest input first."""
    ordered = sorted(results, key=lambda r: r.input_bytes)
    mb = lambda n: f"{n / 1e6:.3f}"
    name = lambda r: r.corpus.replace("_", "\\_")
    sizes = [[name(r), str(r.graphs), mb(r.input_bytes), mb(r.minified_bytes), mb(r.payload_bytes), f"{r.reduction:.1f}\\%"] for r in ordered]
    times = [[name(r), f"{r.compress_s:.2f}", f"{r.decompress_s:.2f}", f"{r.peak_mb:.0f}", "yes" if r.lossless else "no"] for r in ordered]
    path = f"{folder}/tables.tex"
    tables = _latex("Sizes in MB", ["Corpus", "Graphs", "Original", "Minified", "Payload", "Reduction"], sizes) + _latex("Times in seconds, memory in MB", ["Corpus", "Compress", "Decompress", "Peak", "Lossless"], times)
    files.put_text(spark, path, tables)
    return path


def save_figures(spark: SparkSession, results: list[Result], folder: str) -> list[str]:
    """Reduction and storage bars, and time over size with its fit; none without a plotting library."""
    try:
        import matplotlib
    except ImportError:
        return []
    matplotlib.use("Agg")
    from matplotlib import pyplot

    ordered, saved = sorted(results, key=lambda r: r.input_bytes), []

    def save(figure, name: str) -> None:
        for kind in ("pdf", "png"):
            saved.append(f"{folder}/{name}.{kind}")
            with files.opened(saved[-1], "wb") as f:
                figure.savefig(f, format=kind)
        pyplot.close(figure)

    figure, axes = pyplot.subplots()
    axes.bar([r.corpus for r in ordered], [r.reduction for r in ordered])
    axes.set_ylabel("reduction, %")
    save(figure, "reduction")
    figure, axes = pyplot.subplots()
    for shift, field in ((-0.2, "input_bytes"), (0.2, "payload_bytes")):
        axes.bar([i + shift for i in range(len(ordered))], [getattr(r, field) / 1e6 for r in ordered], 0.4, label=field)
    axes.legend()
    save(figure, "storage")
    own = [r for r in ordered if not r.is_pooled]
    fit = stats.scaling_fit(table(spark, own)).first() if own else None
    if fit and fit["slope"] is not None:
        figure, axes = pyplot.subplots()
        x = [r.input_bytes for r in own]
        axes.scatter(x, [r.compress_s for r in own])
        axes.plot(x, [fit["slope"] * v + fit["intercept"] for v in x], label=f"R2 = {fit['r2']:.3f}")
        axes.legend()
        save(figure, "scaling")
    return saved


def run(spark: SparkSession, sources: dict[str, str], out: str, pooled_name: str | None = None, figures: bool = True, work: str | None = None) -> int:
    """Measure corpora (name: folder), write reports; 0 if all are lossless."""
    results, failed = [], []
    for name, source in sources.items():
        try:
            results.append(measure(spark, source, name, work))
            if not results[-1].lossless:
                failed.append(name)
        except OSError as e:
            print(f"{name}: {e}")
            failed.append(name)
    if pooled_name and len(results) > 1 and not failed:
        results.append(pool(results, pooled_name))
    save_json(spark, results, out, failed)
    save_latex(spark, results, out)
    if figures:
        save_figures(spark, results, out)
    return int(bool(failed))
