"""Command line: ``python -m tequant.cli -b x.sam -r te.bed``."""

from __future__ import annotations

import argparse
import logging
import os

from pyspark import SparkConf
from pyspark.sql import DataFrame, SparkSession

from tequant import __version__
from tequant.config import STRANDS, QuantConfig
from tequant.plans.quantify import run
from tequant.sinks.files import write_annotation
from tequant.sources.annotation import ASSEMBLIES, read_bed, read_repeatmasker, read_whitelist
from tequant.sources.bam import indexed_counts, read_bam
from tequant.sources.sam import read_sam


def parser() -> argparse.ArgumentParser:
    # The options, their types and defaults.
    p = argparse.ArgumentParser(prog="tequant", description="Counts repeat expression per cell.")
    p.add_argument("-b", "--bam", required=True, help="alignments: BAM, SAM text, or a Parquet table of alignments")
    p.add_argument("-r", "--regions", help="annotation as BED; goes before --genome")
    p.add_argument("-g", "--genome", choices=sorted(ASSEMBLIES), help="assembly; its .out file is given with --repeats")
    p.add_argument("--repeats", help="path of the assembly's .out file")
    p.add_argument("-w", "--whitelist")
    p.add_argument("-c", "--cb-tag", default="CB")
    p.add_argument("-u", "--umi-tag", default="UR")
    p.add_argument("-l", "--locus", action="store_true")
    p.add_argument("--no-umi", action="store_true")
    p.add_argument("-p", "--threads", type=int, default=1, help="of a local run; without effect where Spark is given a master")
    p.add_argument("--parts", action="store_true", help="leaves each output as a folder of parts, as the executors wrote them")
    p.add_argument("-o", "--outdir", default="tequant_out")
    p.add_argument("--min-bp-overlap", type=int)
    p.add_argument("--min-fraction-overlap", type=float)
    p.add_argument("--strandedness", choices=STRANDS, default="unstranded")
    p.add_argument("--max-iters", type=int, default=100)
    p.add_argument("--tolerance", type=float, default=1e-4)
    p.add_argument("--dump-ec", action="store_true")
    p.add_argument("--integers", action="store_true", help="accepted, without effect")
    p.add_argument("--no-tags-check", action="store_true")
    p.add_argument("--keeptmp", action="store_true", help="also writes the mappings")
    p.add_argument("-v", "--verbose", action="count", default=0)
    p.add_argument("-V", "--version", action="version", version=f"%(prog)s {__version__}")
    return p


def annotated_bam(spark: SparkSession, path: str, annotation: DataFrame, tags: list[str]) -> DataFrame:
    """The alignments of a BAM file. With an index, those of annotated references alone, and the others are named in the log."""
    counts = indexed_counts(path)
    if counts is None:
        return read_bam(spark, path, tags=tags)
    chroms = {r[0] for r in annotation.select("chrom").distinct().collect()}  # one row per reference
    for name in (n for n, mapped in counts.items() if mapped and n not in chroms):
        logging.getLogger("tequant").warning("reference %s is not in the annotation", name)
    return read_bam(spark, path, tags=tags, references=[n for n in counts if n in chroms])


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    logging.basicConfig(level=[logging.WARNING, logging.INFO, logging.DEBUG][min(a.verbose, 2)], format="[%(asctime)s] %(message)s")
    if not a.regions and not (a.genome and a.repeats):
        raise SystemExit("give --regions, or --genome with --repeats")
    cfg = QuantConfig(cb_tag=a.cb_tag, umi_tag=a.umi_tag, no_umi=a.no_umi, locus=a.locus, min_bp_overlap=a.min_bp_overlap, min_fraction_overlap=a.min_fraction_overlap, strandedness=a.strandedness, max_iters=a.max_iters, tolerance=a.tolerance, dump_ec=a.dump_ec, keep_mappings=a.keeptmp, tags_check=not a.no_tags_check, integers=a.integers)
    builder = SparkSession.builder.appName("tequant")
    if not SparkConf().contains("spark.master") and "MASTER" not in os.environ:  # else spark-submit or the session has one
        builder = builder.master(f"local[{a.threads}]")
    spark = SparkSession.getActiveSession() or builder.getOrCreate()
    annotation = read_bed(spark, a.regions) if a.regions else read_repeatmasker(spark, a.repeats, header_lines=ASSEMBLIES[a.genome], locus=a.locus)
    if a.bam.endswith(".bam"):
        alignments = annotated_bam(spark, a.bam, annotation, [cfg.cb_tag, cfg.umi_tag])
    else:
        alignments = spark.read.parquet(a.bam) if a.bam.endswith(".parquet") else read_sam(spark, a.bam)
    if not a.regions:
        write_annotation(annotation, f"{a.outdir}/rmsk.bed.gz", merge=not a.parts)
    run(alignments, annotation, cfg, a.outdir, read_whitelist(spark, a.whitelist) if a.whitelist else None, merge=not a.parts)


if __name__ == "__main__":
    main()
