"""The registered queries: every operator of a run over the views of ``testviews``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tequant.functions.columns import round3
from tequant.operators import counts as C
from tequant.operators import filters, mappings, overlap, umi_graph
from tequant.plans import testviews as V
from tequant.plans.oracles import ORACLES
from tequant.plans.quantify import Quantification, matrix_header, quantify
from tequant.sources.annotation import repeat_loci
from tequant.staging import cut

__all__ = ["ORACLES", "QUERIES"]


def _valid(spark: SparkSession, d: str, **more) -> DataFrame:
    return filters.valid_alignments(V.alignments(spark, d), V.config(**more))


def _hits(spark: SparkSession, d: str, **more) -> DataFrame:
    return overlap.overlaps(_valid(spark, d, **more), V.annotation(spark, d), V.config(**more))


def _read_sets(spark: SparkSession, d: str, **more) -> DataFrame:
    return overlap.read_sets(_valid(spark, d, **more), V.annotation(spark, d), V.config(**more))


def _maps(spark: SparkSession, d: str, **more) -> DataFrame:
    reads = _read_sets(spark, d, **more)
    return mappings.single_reads(reads) if more.get("no_umi") else mappings.class_counts(reads)


def _ecs(spark: SparkSession, d: str, **more) -> DataFrame:
    return mappings.equivalence_classes(_maps(spark, d, **more))


def _run(spark: SparkSession, d: str, te: DataFrame | None = None, **more) -> Quantification:
    return quantify(V.alignments(spark, d), V.annotation(spark, d) if te is None else te, V.config(**more))


def _loci(spark: SparkSession, d: str) -> DataFrame:
    return repeat_loci(V.repeat_rows(spark, d), locus=True)


def _flat(df: DataFrame) -> DataFrame:
    return df.withColumn("features", F.array_join("features", ","))


def _reads(spark: SparkSession, d: str) -> DataFrame:
    return C.reads_as_units(cut(_maps(spark, d, no_umi=True)))


def _fine(df: DataFrame) -> DataFrame:
    """Shares to 9 decimals. What lies within summation error of a tie, as shares k / 2^n do, goes up, so the order of sums does not show."""
    return df.withColumn("p", F.floor(F.col("p") * 1e9 + 0.5001) / 1e9)


def _rounded(stats: DataFrame) -> DataFrame:
    return stats.withColumns({"loglik": round3(F.col("loglik")), "increment": F.rint(F.col("increment") * 1e6) / 1e6})


def _plain(df: DataFrame) -> DataFrame:
    return df.select("aid", "cb", "umi", "read", "chrom", "strand")


def _small_units(spark: SparkSession, d: str) -> DataFrame:
    """The molecules of components of one or two classes, which are one molecule each."""
    return _flat(C.molecules(_ecs(spark, d), most=2).select("cb", "root", F.size("members").cast("long").alias("size"), "features"))


def _some_annotation(s: SparkSession, d: str) -> DataFrame:
    return V.annotation(s, d).where("chrom <> 'chr3'")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "valid_alignments": lambda s, d: _plain(_valid(s, d)),
    "valid_alignments_no_umi": lambda s, d: _plain(_valid(s, d, no_umi=True)),
    "whitelist_semi": lambda s, d: filters.valid_alignments(V.alignments(s, d), V.config(), V.whitelist(s)).select("aid", "cb", "umi"),
    "chrom_missing_anti": lambda s, d: filters.missing_references(V.alignments(s, d), _some_annotation(s, d)),
    "chrom_common_semi": lambda s, d: V.alignments(s, d).select("chrom").distinct().join(_some_annotation(s, d), "chrom", "left_semi"),
    "tag_check": lambda s, d: filters.check_tags(V.alignments(s, d), V.config()),
    "chrom_mapped_counts": lambda s, d: filters.mapped_counts(V.alignments(s, d)),
    "annotation_subfamilies": lambda s, d: repeat_loci(V.repeat_rows(s, d)),
    "annotation_loci": _loci,
    "overlap_hits": _hits,
    "overlap_hits_forward": lambda s, d: _hits(s, d, strandedness="forward"),
    "overlap_hits_reverse": lambda s, d: _hits(s, d, strandedness="reverse"),
    "overlap_hits_min_bp": lambda s, d: _hits(s, d, min_bp_overlap=20),
    "overlap_hits_min_fraction": lambda s, d: _hits(s, d, min_fraction_overlap=0.5),
    "overlap_hits_whitelist": lambda s, d: overlap.overlaps(filters.valid_alignments(V.alignments(s, d), V.config(), V.whitelist(s)), V.annotation(s, d), V.config()),
    "read_feature_sets": lambda s, d: _flat(_read_sets(s, d)),
    "mappings": lambda s, d: _flat(_maps(s, d)),
    "mappings_no_umi": lambda s, d: _flat(_maps(s, d, no_umi=True)),
    "barcode_index": lambda s, d: mappings.barcode_index(overlap.met_cells(_valid(s, d), V.annotation(s, d), V.config())),
    "feature_index": lambda s, d: mappings.feature_index(overlap.met_features(_valid(s, d), V.annotation(s, d), V.config())),
    "feature_index_locus": lambda s, d: _run(s, d, _loci(s, d), locus=True).features,
    "ec_index": lambda s, d: _flat(_ecs(s, d)),
    "umi_candidate_pairs": lambda s, d: umi_graph.candidate_pairs(_ecs(s, d)),
    "umi_edges": lambda s, d: umi_graph.edges(_ecs(s, d)),
    "umi_components": lambda s, d: C.component_labels(_ecs(s, d), few=0),  # by rounds alone
    "umi_parents": lambda s, d: umi_graph.parents(_ecs(s, d)),
    "umi_units_small": _small_units,
    "umi_units": lambda s, d: _flat(C.molecules(_ecs(s, d)).select("cb", "unit_id", "root", "features")),
    "ec_dump": lambda s, d: _run(s, d).dump,
    "ec_dump_no_umi": lambda s, d: _run(s, d, no_umi=True).dump,
    "unique_counts_no_umi": lambda s, d: C.unique_counts(_reads(s, d)),
    "em_one_step": lambda s, d: _fine(C.em_shares(_reads(s, d), 1)),
    "em_fixed5": lambda s, d: _fine(C.em_shares(_reads(s, d), 5)),
    "em_loglik": lambda s, d: C.em_loglik(_reads(s, d), 1).withColumn("loglik", round3(F.col("loglik"))),
    "counts_no_umi_k5": lambda s, d: C.reported(C.counts_by_cycles(_reads(s, d), 5)),
    "counts_no_umi_kernel_k5": lambda s, d: C.reported(C.raw_counts(_reads(s, d), V.config(no_umi=True, max_iters=5, tolerance=0.0))),
    "counts_umi": lambda s, d: _run(s, d).counts,
    "counts_no_umi": lambda s, d: _run(s, d, no_umi=True).counts,
    "counts_locus": lambda s, d: _run(s, d, _loci(s, d), locus=True).counts,
    "counts_no_umi_dataflow": lambda s, d: C.reported(C.raw_counts(_reads(s, d), V.config(no_umi=True), cell=0)),
    "em_stats": lambda s, d: _rounded(C.em_stats(_run(s, d).units, V.config())),
    "em_stats_no_umi": lambda s, d: _rounded(C.em_stats(_reads(s, d), V.config(no_umi=True))),
    "matrix_header_no_umi_k5": lambda s, d: matrix_header(_run(s, d, no_umi=True, max_iters=5, tolerance=0.0)),
    "matrix_header_no_umi": lambda s, d: matrix_header(_run(s, d, no_umi=True)),
    "matrix_header": lambda s, d: matrix_header(_run(s, d)),
}
