"""Counts per cell and feature. The kernel takes a component of the UMI graph at a time, and a cell's expectation-maximisation unless the
cell is large; all else is relational."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tequant.config import QuantConfig
from tequant.functions.columns import round3
from tequant.operators import kernel
from tequant.operators.components import FEW, linked_components
from tequant.operators.em_dataflow import settle
from tequant.operators.umi_graph import binding_links, edges  # noqa: F401, a test of an index puts a trap there
from tequant.staging import cut, waves

LEAST = 0.001


#: Tasks to a task of other work, for the covers of components.
SPREAD = 4

#: Cells of the matrix (class or set by feature) up to which a cell's expectation-maximisation is one group of the kernel.
CELL = 1 << 20


def component_labels(ecs: DataFrame, links: DataFrame | None = None, *, few: int = FEW) -> DataFrame:
    """(cb, ec_index, component): the smallest class of each weak component."""
    found = linked_components(binding_links(ecs) if links is None else links, few)
    return ecs.select("cb", "ec_index").join(found, ["cb", "ec_index"], "left").select("cb", "ec_index", F.coalesce("component", "ec_index").alias("component"))


def _fields(lists: pa.ListArray) -> tuple[list[int], list[pa.Array]]:
    """Where each list of structs begins in all of them, and ends; their fields."""
    flat = lists.flatten()
    return [0, *np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)).tolist()], flat.flatten()


def _molecules(rows: list[tuple]) -> pa.RecordBatch:
    cb, root, members, found = zip(*rows, strict=True) if rows else ((),) * 4
    return pa.RecordBatch.from_arrays([pa.array(cb, pa.string()), pa.array(root, pa.int32()), pa.array(members, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.string()))], ["cb", "root", "members", "features"])


def _components(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The molecules of components (cb, nodes, links), or (cb, nodes) whose nodes have UMIs and reads too, by which they are linked."""
    for batch in batches:
        out: list[tuple] = []
        for at in range(0, batch.num_rows, 256):
            some = batch.slice(at, 256)
            of_node, (index, held, *more) = _fields(some.column(1))
            index, held, more = index.to_pylist(), held.to_pylist(), [x.to_pylist() for x in more]
            after = _given(some) if batch.num_columns > 2 else (None for _ in range(some.num_rows))
            for cb, a, b, links in zip(some.column(0).to_pylist(), of_node, of_node[1:], after, strict=False):
                features = dict(zip(index[a:b], map(frozenset, held[a:b]), strict=True))
                if links is None:
                    links = kernel.given_rise(index[a:b], features, *(x[a:b] for x in more))
                out += [(cb, *u) for u in kernel.component_molecules(sorted(features), features, links, set().union(*links.values()))]
        yield _molecules(out)


def _given(some: pa.RecordBatch) -> Iterator[dict[int, list[int]]]:
    """The links of each component, in order."""
    of_link, fields = _fields(some.column(2))
    src, dst = (x.to_numpy() for x in fields)
    order = np.lexsort((dst, src, np.repeat(np.arange(some.num_rows), np.diff(of_link))))
    src, dst = src[order].tolist(), dst[order].tolist()
    for c, d in zip(of_link, of_link[1:], strict=False):
        after: dict[int, list[int]] = {}
        for x, y in zip(src[c:d], dst[c:d], strict=True):
            after.setdefault(x, []).append(y)
        yield after


def molecules(ecs: DataFrame, *, few: int = FEW, most: int | None = None) -> DataFrame:
    """(cb, unit_id, root, members, features) by the UMI graph; a molecule's id is its root.

    A class without links is a molecule as it is. The others go to the kernel by component, not by cell, and are linked there: links grow
    with the square of a cell, so none is written or shuffled.
    Only components of ``most`` classes at most count, if it is given; the others are left out before the kernel.
    """
    labels = linked_components(binding_links(ecs), few)
    if most is not None:
        large = labels.groupBy("cb", "component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("cb", "component")
        beyond = cut(labels.join(large, ["cb", "component"], "left_semi").select("cb", "ec_index"))
        ecs, labels = (t.join(beyond, ["cb", "ec_index"], "left_anti") for t in (ecs, labels))
    rows = ecs.join(labels, ["cb", "ec_index"], "left")
    alone = rows.where("component IS NULL").select("cb", F.col("ec_index").alias("root"), F.array("ec_index").alias("members"), "features")
    node = rows.where("component IS NOT NULL").select("cb", "component", F.struct("ec_index", "features", "umi", "read_count").alias("node"))
    # adaptive execution would put several large components into a task, as their rows are few; so would chance, were there few more tasks than those
    parts = node.repartition(SPREAD * waves(ecs.sparkSession), "cb", "component")
    whole = parts.groupBy("cb", "component").agg(F.collect_list("node").alias("nodes"))
    found = whole.select("cb", "nodes").mapInArrow(_components, "cb string, root int, members array<int>, features array<string>")
    return alone.unionByName(found).select("cb", F.col("root").alias("unit_id"), "root", "members", "features")


def reads_as_units(maps: DataFrame) -> DataFrame:
    """(cb, unit_id, features) without UMIs: every class is one read, and goes by its name. Classes need no numbers for that."""
    return maps.select("cb", F.col("umi").alias("unit_id"), "features")


def _weighed(units: DataFrame) -> DataFrame:
    """(cb, features, weight): the sets of several features of each cell, and how many molecules have them."""
    return units.where(F.size("features") > 1).groupBy("cb", "features").agg(F.count(F.lit(1)).alias("weight"))


def _fit(pdf: pd.DataFrame, cfg: QuantConfig) -> tuple[list, kernel.Fit]:
    pdf = pdf.assign(key=pdf["features"].map(tuple)).sort_values("key")  # the order of sums must not depend on the shuffle
    return kernel.fit_sets(pdf["key"].tolist(), pdf["weight"].to_numpy(), cfg.max_iters, cfg.tolerance)


def _split(weighed: DataFrame, cell: int) -> tuple[DataFrame, DataFrame]:
    """The sets of cells with at most so many cells of the matrix, and of those with more."""
    sizes = weighed.groupBy("cb").agg(F.sum(F.size("features")).alias("n")).where(F.col("n") > cell).select("cb")
    large = cut(sizes)
    return weighed.join(large, "cb", "left_anti"), weighed.join(large, "cb", "left_semi")


def settled_shares(units: DataFrame, cfg: QuantConfig, *, cell: int = CELL) -> DataFrame:
    """(cb, feature_id, p) of the molecules with several features: by the kernel cell by cell, for large cells as a dataflow."""
    weighed = cut(_weighed(units))
    small, large = _split(weighed, cell)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, f = _fit(pdf, cfg)
        return pd.DataFrame({"cb": pdf["cb"].iloc[0], "feature_id": names, "p": f.share})

    out = small.groupBy("cb").applyInPandas(run, "cb string, feature_id string, p double")
    return out if large.isEmpty() else out.unionByName(settle(large, cfg.max_iters, cfg.tolerance)[0])


def raw_counts(units: DataFrame, cfg: QuantConfig, *, cell: int = CELL) -> DataFrame:
    """(cb, feature_id, count): molecules with one feature count as they are, the others by EM within the cell."""
    return _with_unique(units, settled_shares(units, cfg, cell=cell))


def _with_unique(units: DataFrame, shares: DataFrame) -> DataFrame:
    n = units.where(F.size("features") > 1).groupBy("cb").agg(F.count(F.lit(1)).alias("n"))
    shared = shares.where("p > 0").join(n, "cb").select("cb", "feature_id", (F.col("p") * F.col("n")).alias("count"))
    return unique_counts(units).unionByName(shared).groupBy("cb", "feature_id").agg(F.sum("count").alias("count"))


def em_stats(units: DataFrame, cfg: QuantConfig, *, cell: int = CELL) -> DataFrame:
    """(cb, cycles, converged, loglik, increment) of the cells with molecules of several features."""
    weighed = cut(_weighed(units))
    small, large = _split(weighed, cell)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        _, f = _fit(pdf, cfg)
        return pd.DataFrame({"cb": [pdf["cb"].iloc[0]], "cycles": [f.cycles], "converged": [f.converged], "loglik": [f.loglik], "increment": [f.increment]})

    out = small.groupBy("cb").applyInPandas(run, "cb string, cycles int, converged boolean, loglik double, increment double")
    return out if large.isEmpty() else out.unionByName(settle(large, cfg.max_iters, cfg.tolerance)[1])


def reported(counts: DataFrame) -> DataFrame:
    """Leaves counts of 0.001 or more, then rounds to three decimals."""
    return counts.where(F.col("count") >= LEAST).withColumn("count", round3(F.col("count")))


def indexed(counts: DataFrame, barcodes: DataFrame, features: DataFrame) -> DataFrame:
    """(feature_idx, barcode_idx, count)."""
    rows = counts.join(barcodes, "cb").join(features.select("feature_idx", "feature_id"), "feature_id")
    return rows.select("feature_idx", "barcode_idx", "count")


def unique_counts(units: DataFrame) -> DataFrame:
    """(cb, feature_id, count) of the molecules with one feature."""
    one = units.where(F.size("features") == 1).select("cb", F.col("features")[0].alias("feature_id"))
    return one.groupBy("cb", "feature_id").agg(F.count(F.lit(1)).cast("double").alias("count"))


def em_shares(units: DataFrame, cycles: int) -> DataFrame:
    """(cb, feature_id, p) after a fixed number of cycles, relational throughout. Units with the same features count as one set."""
    return settle(cut(_weighed(units)), cycles, -1.0)[0]


def em_loglik(units: DataFrame, cycles: int) -> DataFrame:
    """(cb, loglik) of the shares after a fixed number of cycles."""
    return settle(cut(_weighed(units)), cycles, -1.0)[1].select("cb", "loglik")


def counts_by_cycles(units: DataFrame, cycles: int) -> DataFrame:
    """(cb, feature_id, count) with a fixed number of cycles, relational throughout."""
    return _with_unique(units, em_shares(units, cycles))


def ec_dump(ecs: DataFrame, units: DataFrame | None, barcodes: DataFrame) -> DataFrame:
    """One row per class; with UMIs also the UMI and features of the molecule that took it in, empty for the molecule's own class."""
    rows = ecs.join(barcodes, "cb")
    base = [F.col("barcode_idx").alias("Barcode_id"), F.col("cb").alias("Barcode"), F.col("ec_index").alias("EqClass")]
    joined = F.array_join("features", ",").alias("Features")
    if units is None:
        return rows.select(*base, F.col("umi").alias("Read_name"), joined, F.col("read_count").alias("Read_count"))
    taken = units.select("cb", "root", F.col("features").alias("unit_features"), F.explode("members").alias("ec_index")).where("root <> ec_index")
    roots = ecs.select("cb", F.col("ec_index").alias("root"), F.col("umi").alias("root_umi"))
    rows = rows.join(taken.join(roots, ["cb", "root"]), ["cb", "ec_index"], "left")
    dedup = [F.coalesce("root_umi", F.lit("")).alias("Dedup_UMI"), F.coalesce(F.array_join("unit_features", ","), F.lit("")).alias("Dedup_feature")]
    return rows.select(*base, F.col("umi").alias("UMI"), joined, F.col("read_count").alias("Read_count"), *dedup)
