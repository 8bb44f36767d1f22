"""Overlap join of alignment blocks and annotated intervals.

Spark has no interval join. An annotation of INDEX_BYTES at most goes to the tasks as a packed index, which each batch of alignments is
searched in: alignments are neither exploded nor shuffled, and their blocks add up where they are. If the features of reads are all that is
asked for, a batch hands on what its reads meet in it, not each hit.

A larger annotation is dealt to fixed bins, as are the blocks, and joined on (chromosome, bin): a pair that shares several bins is
kept in the first of them alone, which makes the result exact without a distinct. A bin that is hot is split by adaptive execution, as it
is an ordinary inner equi-join. Both ways give the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tequant.config import QuantConfig
from tequant.operators.interval_index import IntervalIndex
from tequant.operators.mappings import merged_sets, read_features, read_name

INDEX_BYTES = 256 << 20
ROW_BYTES = 32  # of an interval in the index, without its feature, which is held once


def _bins(start: Column, end: Column, width: int) -> Column:
    return F.explode(F.sequence(F.floor(start / width), F.floor((end - 1) / width)))


def _wanted_strand(annotation: DataFrame, cfg: QuantConfig) -> Column:
    """The strand an alignment must have to count for an interval."""
    if cfg.strandedness == "unstranded":
        return F.lit(None).cast("string")
    if "strand" not in annotation.columns:
        raise ValueError("stranded counting needs an annotation with strands")
    return F.col("strand") if cfg.strandedness == "forward" else F.when(F.col("strand") == "+", "-").otherwise("+")


def overlaps(alignments: DataFrame, annotation: DataFrame, cfg: QuantConfig, *, index_bytes: int = INDEX_BYTES, carry: tuple[str, ...] = ()) -> DataFrame:
    """(aid, cb, umi, read, te_id, feature, ov), and the columns of ``carry``, for each alignment and interval that meet the overlap and strand conditions.

    Overlaps add up over an alignment's blocks. The least overlap is 1 bp, or what the configuration asks for: bp, or a fraction of the
    alignment's block lengths. The annotation is measured, and read to the driver if it is small enough for the index.
    """
    te, small = _measured(annotation, cfg, index_bytes)
    return (indexed_overlaps if small else binned_overlaps)(alignments, te, cfg, carry)


def read_sets(alignments: DataFrame, annotation: DataFrame, cfg: QuantConfig, *, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """(cb, umi, read, features) of the overlaps, as ``read_features`` has them. Without UMIs the name that stands in for one tells reads apart."""
    te, small = _measured(annotation, cfg, index_bytes)
    if not small:
        return read_features(binned_overlaps(alignments, te, cfg))
    by = ["cb", "umi"] if cfg.no_umi else ["cb", "umi", "read"]
    rows = alignments.select(*by, *_place(cfg))
    schema = ", ".join(f"{c} {k}" for c, k in rows.dtypes[: len(by)]) + f", features array<{dict(te.dtypes)['feature']}>"
    sets = merged_sets(_searched(rows, te, cfg, "sets", schema), *by)
    return sets.select("cb", "umi", read_name(F.col("umi")).alias("read"), "features") if cfg.no_umi else sets


def met_cells(alignments: DataFrame, annotation: DataFrame, cfg: QuantConfig, *, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """(cb) of the overlaps, distinct. No read is put together, nor shuffled."""
    te, small = _measured(annotation, cfg, index_bytes)
    if not small:
        return binned_overlaps(alignments, te, cfg).select("cb").distinct()
    return _searched(alignments.select("cb", *_place(cfg)), te, cfg, "cells", f"cb {dict(alignments.dtypes)['cb']}").distinct()


def met_features(alignments: DataFrame, annotation: DataFrame, cfg: QuantConfig, *, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """(features): sets that have all features of the overlaps between them. No read is put together, nor shuffled."""
    te, small = _measured(annotation, cfg, index_bytes)
    if not small:
        return binned_overlaps(alignments, te, cfg).where("feature IS NOT NULL").select("feature").distinct().select(F.array("feature").alias("features"))
    return _searched(alignments.select(*_place(cfg)), te, cfg, "features", f"features array<{dict(te.dtypes)['feature']}>")


def _place(cfg: QuantConfig) -> list[str]:
    return ["chrom", *["strand"] * (cfg.strandedness != "unstranded"), "blocks"]


def _measured(annotation: DataFrame, cfg: QuantConfig, index_bytes: int) -> tuple[DataFrame, bool]:
    """(te_id, chrom, start, end, feature, wanted strand), and whether an index of it takes so many bytes at most."""
    te = annotation.where("start < end").select("te_id", "chrom", "start", "end", "feature", _wanted_strand(annotation, cfg).alias("strand"))
    of = te.groupBy("feature").agg(F.count(F.lit(1)).alias("n"))
    size = of.agg(F.sum(F.col("n") * ROW_BYTES + F.coalesce(F.octet_length("feature"), F.lit(0)))).first()[0]
    return te, (size or 0) <= index_bytes


def _searched(rows: DataFrame, te: DataFrame, cfg: QuantConfig, kind: str, schema: str) -> DataFrame:
    """What the index's method of that name gives for the batches of ``rows``."""
    index = te.sparkSession.sparkContext.broadcast(vars(IntervalIndex(te.where("chrom IS NOT NULL").toArrow())))
    strands, least, fraction = cfg.strandedness != "unstranded", cfg.min_bp_overlap or 1, float(cfg.min_fraction_overlap or 0)
    return rows.mapInArrow(lambda batches: IntervalIndex.of(index.value).search(batches, kind, strands, least, fraction), schema)


def indexed_overlaps(alignments: DataFrame, te: DataFrame, cfg: QuantConfig, carry: tuple[str, ...] = ()) -> DataFrame:
    """By the index. ``te`` has the columns te_id, chrom, start, end, feature and the wanted strand."""
    rows = alignments.select("aid", "cb", "umi", "read", "chrom", "strand", "blocks", *carry)
    kinds = {**dict(rows.dtypes), **dict(te.dtypes)}
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("aid", "cb", "umi", "read", "te_id", "feature")) + ", ov long" + "".join(f", `{c}` {kinds[c]}" for c in carry)
    return _searched(rows, te, cfg, "hits", schema)


def binned_overlaps(alignments: DataFrame, te: DataFrame, cfg: QuantConfig, carry: tuple[str, ...] = ()) -> DataFrame:
    """By bins, with ``te`` as above."""
    w = cfg.bin_width
    length = F.aggregate("blocks", F.lit(0).cast("long"), lambda s, b: s + b.end - b.start)
    blocks = alignments.select("aid", "cb", "umi", "read", "chrom", F.col("strand").alias("a_strand"), length.alias("length"), F.explode("blocks").alias("b"), *carry)
    blocks = blocks.select("*", F.col("b.start").alias("a_start"), F.col("b.end").alias("a_end")).drop("b").where("a_start < a_end")
    blocks = blocks.select("*", _bins(F.col("a_start"), F.col("a_end"), w).alias("bin"))
    te = te.select("te_id", "chrom", F.col("start").alias("t_start"), F.col("end").alias("t_end"), "feature", F.col("strand").alias("a_strand"))
    te = te.select("*", _bins(F.col("t_start"), F.col("t_end"), w).alias("bin"))
    on = ["chrom", "bin"] + ["a_strand"] * (cfg.strandedness != "unstranded")
    pairs = blocks.join(te if len(on) == 3 else te.drop("a_strand"), on).where((F.col("a_start") < F.col("t_end")) & (F.col("t_start") < F.col("a_end")))
    pairs = pairs.where(F.col("bin") == F.floor(F.greatest("a_start", "t_start") / w))
    ov = F.least("a_end", "t_end") - F.greatest("a_start", "t_start")
    same = lambda c: F.any_value(c).alias(c)  # noqa: E731  one value for an alignment or an interval
    out = pairs.groupBy("aid", "te_id").agg(F.sum(ov).alias("ov"), *map(same, ("cb", "umi", "read", "feature", "length", *carry)))
    if cfg.min_bp_overlap:
        out = out.where(F.col("ov") >= cfg.min_bp_overlap)
    if cfg.min_fraction_overlap:
        out = out.where(F.col("ov") >= F.lit(float(cfg.min_fraction_overlap)) * F.col("length"))
    return out.select("aid", "cb", "umi", "read", "te_id", "feature", "ov", *carry)
