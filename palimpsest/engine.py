"""Comparison of document pairs in one call, and from the command line."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from palimpsest.logs import get_logger, setup_logging
from palimpsest.params import Params, load_params
from palimpsest.sources.adapters import page_counts, pdf_blocks
from palimpsest.streaming.progress import compare_stream


def compare(blocks: DataFrame, pages: DataFrame | None = None, params: Params = Params(), out_dir: str | None = None) -> dict[str, DataFrame]:
    """nodes, vectors, changes, packs, summaries and counts of all pairs in ``blocks``."""
    last = None
    for last in compare_stream(blocks, page_counts(blocks) if pages is None else pages, params, out_dir):
        get_logger("engine").debug("%s (%d %%): %s", last.stage, last.percent, last.message)
    return last.result


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Compare two versions of a document.")
    parser.add_argument("--legacy", required=True, help="PDF, or a folder of block rows as Parquet")
    parser.add_argument("--modern", required=True)
    parser.add_argument("--output-root", default="outputs")
    parser.add_argument("--config")
    parser.add_argument("--logs-dir", help="folder of log files on the driver; none are written without it")
    args = parser.parse_args(argv)
    if args.logs_dir:
        setup_logging(args.logs_dir)
    spark = SparkSession.builder.appName("compare").getOrCreate()
    sides = []
    for side in ("legacy", "modern"):
        path = getattr(args, side)
        sides.append(pdf_blocks(spark, path, "pair", side) if path.lower().endswith(".pdf") else spark.read.parquet(path))
    result = compare(sides[0].unionByName(sides[1]), params=load_params(args.config), out_dir=args.output_root)
    result["counts"].show(truncate=False)


if __name__ == "__main__":
    main()
