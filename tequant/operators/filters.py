"""Row filters on alignments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tequant.config import QuantConfig
from tequant.functions.columns import tag
from tequant.operators.mappings import read_name

LISTED = 4096


class MissingTags(ValueError):
    """No record has the tags asked for."""


def valid_alignments(alignments: DataFrame, cfg: QuantConfig, whitelist: DataFrame | None = None, *, carry: tuple[str, ...] = ()) -> DataFrame:
    """aid, cb, umi, read, chrom, strand, blocks of the alignments with a usable barcode (and UMI).

    Barcodes that are empty or ``-`` go; so do UMIs that are empty, hold an N or repeat one base. Without UMIs the read's name stands
    in for one. Columns of ``carry`` stay. The whitelist holds whole tag values. One of LISTED values at most is a condition, which goes down
    to where barcodes come from, before other rows are made; with a larger one Spark chooses by its size how the semi-join runs.
    """
    whole, listed, some = F.col("tags").getItem(cfg.cb_tag), None, []
    if whitelist is not None:
        listed = whitelist.select(F.col("cb").alias("_listed")).where("_listed IS NOT NULL")
        some = [r[0] for r in listed.distinct().limit(LISTED + 1).collect()]
        if len(some) <= LISTED:
            alignments, listed = alignments.where(whole.isin(some)), None
    umi = F.col("qname") if cfg.no_umi else tag(F.col("tags"), cfg.umi_tag, split_on_colon=cfg.split_tag_on_colon)
    cb = tag(F.col("tags"), cfg.cb_tag, split_on_colon=cfg.split_tag_on_colon)
    rows = alignments.select("aid", cb.alias("cb"), umi.alias("umi"), read_name(F.col("qname")).alias("read"), "chrom", "strand", "blocks", *carry, *[whole.alias("_whole")] * (listed is not None))
    rows = rows.where(~F.col("cb").isin("", "-"))
    # a fixed value: UMIs that repeat one base; the pattern is tried on those alone that begin with two equal letters or are shorter
    begins = (F.length("umi") < 2) | (F.substring("umi", 1, 1) == F.substring("umi", 2, 1))
    rows = rows if cfg.no_umi else rows.where(~F.contains("umi", F.lit("N")) & ~(begins & F.col("umi").rlike("^$|^(A+|G+|T+|C+)$")))
    return rows if listed is None else rows.join(listed, F.col("_whole") == F.col("_listed"), "left_semi").drop("_whole")


def check_tags(alignments: DataFrame, cfg: QuantConfig, records: int = 999_998) -> DataFrame:
    """One row if some of the first records of any partition has the tags; raises nothing itself (see ``require_tags``). Each partition
    looks for itself and hands on a row at most."""
    some = alignments.withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).where(F.col("_at") < records)
    ok = F.coalesce(F.col("tags").getItem(cfg.cb_tag), F.lit("")) != ""
    if not cfg.no_umi:
        ok &= F.coalesce(F.col("tags").getItem(cfg.umi_tag), F.lit("")) != ""
    return some.where(ok).limit(1).select(F.lit(True).alias("has_tags"))


def require_tags(alignments: DataFrame, cfg: QuantConfig) -> None:
    if check_tags(alignments, cfg).isEmpty():
        raise MissingTags(f"no record has the tag {cfg.cb_tag}" + ("" if cfg.no_umi else f" and the tag {cfg.umi_tag}"))


def mapped_counts(alignments: DataFrame) -> DataFrame:
    """(chrom, n): mapped records per reference."""
    return alignments.where(F.col("flag").bitwiseAND(4) == 0).groupBy("chrom").agg(F.count(F.lit(1)).alias("n"))


def missing_references(a: DataFrame, b: DataFrame) -> DataFrame:
    """References of ``a`` that ``b`` has no row of."""
    return a.select("chrom").distinct().join(b.select("chrom").distinct(), "chrom", "left_anti")
