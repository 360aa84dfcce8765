"""Commands: ``python -m provweave.cli compress | decompress | verify | bench``."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession

from .plans import codec, harness


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="provweave", description="Lossless compaction of corpora of provenance graphs.")
    commands = p.add_subparsers(dest="command", required=True)
    c = commands.add_parser("compress", help="compress a directory of documents")
    c.add_argument("--input", required=True), c.add_argument("--out", required=True)
    c.add_argument("--verify", action="store_true"), c.add_argument("--overwrite", action="store_true")
    c = commands.add_parser("decompress", help="rebuild the documents")
    c.add_argument("--input", required=True), c.add_argument("--out", required=True), c.add_argument("--overwrite", action="store_true")
    c = commands.add_parser("verify", help="compare originals with an artifact; fails if any differs")
    c.add_argument("--orig", required=True), c.add_argument("--compressed", required=True)
    c = commands.add_parser("bench", help="measure corpora; fails if any is not lossless")
    c.add_argument("--corpus", action="append", default=[], metavar="[NAME=]DIR"), c.add_argument("--corpus-dir", help="every folder below it is a corpus")
    c.add_argument("--output", required=True), c.add_argument("--pooled-name"), c.add_argument("--skip-figures", action="store_true"), c.add_argument("--work-dir", help="a folder that all executors share")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("provweave").getOrCreate()
    if a.command == "compress":
        print(json.dumps(codec.compress_directory(spark, a.input, a.out, a.verify, a.overwrite), ensure_ascii=False))
    elif a.command == "decompress":
        print(json.dumps({"reconstructed_files": codec.decompress_directory(spark, a.input, a.out, a.overwrite), "output_dir": a.out}))
    elif a.command == "verify":
        found = codec.verify_directory(spark, a.orig, a.compressed)
        print(json.dumps(found, ensure_ascii=False))
        return int(not found["lossless"])
    else:
        sources = {os.path.basename(d.rstrip("/")): os.path.join(a.corpus_dir, d) for d in sorted(os.listdir(a.corpus_dir))} if a.corpus_dir else {}
        for each in a.corpus:
            name, _, folder = each.rpartition("=")
            sources[name or os.path.basename(folder.rstrip("/"))] = folder
        return harness.run(spark, sources, a.output, a.pooled_name, not a.skip_figures, a.work_dir)
    return 0


if __name__ == "__main__":
    sys.exit(main())
