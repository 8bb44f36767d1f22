"""Expectation-maximisation of all cells at once, to convergence, as a dataflow.

For cells whose matrix is too large for one task. A row of the matrix is a set of features with its weight, the number of molecules that
have it. Each cycle is joins and sums keyed by (cell, row) and (cell, feature), whose partial sums split a hot cell or feature; a cell whose
log-likelihood has settled leaves with its shares, and the others go on. Every cycle is written, so lineage stays short.

Up to SHARES shares in all, a cycle is one pass over the sets with the shares of their cells at hand, by the features' numbers in the cell:
what is shuffled are partial sums by cell and feature. With more shares the matrix is joined with them instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tequant.operators.kernel import EPS
from tequant.staging import cut, drop_cut

SHARES = 1 << 22  # doubles, 32 MB


def _rows(cells: DataFrame, shares: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cb, row, s) with each row's share in all, and (cb, loglik)."""
    rows = cut(cells.join(shares, ["cb", "feature_id"]).groupBy("cb", "row").agg(F.sum("p").alias("s"), F.any_value("weight").alias("weight")))
    return rows.select("cb", "row", "s"), rows.groupBy("cb").agg(F.sum(F.col("weight") * F.log(F.col("s") + F.lit(EPS))).alias("loglik"))


def em_until_settled(cells: DataFrame, cycles: int, tolerance: float) -> tuple[DataFrame, DataFrame]:
    """(cb, feature_id, p) and (cb, cycles, converged, loglik, increment) of the matrix (cb, row, feature_id, weight), as the kernel's
    ``fit`` has them: even shares at first, a cell is done after the cycle that gains less than the tolerance, or after so many."""
    cells = cut(cells)
    sizes = cells.select("cb", "feature_id").distinct().groupBy("cb").agg((F.lit(1.0) / F.count(F.lit(1))).alias("p"))
    shares = cut(cells.select("cb", "feature_id").distinct().join(sizes, "cb"))
    rows, loglik = _rows(cells, shares)
    loglik = cut(loglik)
    done: list[tuple[DataFrame, DataFrame]] = []
    for cycle in range(1, cycles + 1):
        part = cells.join(shares, ["cb", "feature_id"]).join(rows, ["cb", "row"]).groupBy("cb", "feature_id").agg(F.sum(F.col("weight") * F.col("p") / F.col("s")).alias("part"))
        part = cut(part)
        total = part.groupBy("cb").agg(F.sum("part").alias("total"))
        new = cut(part.join(total, "cb").select("cb", "feature_id", (F.col("part") / F.col("total")).alias("p")))
        new_rows, new_loglik = _rows(cells, new)
        gain = F.abs(F.col("loglik") - F.col("_before"))
        stats = cut(new_loglik.join(loglik.withColumnRenamed("loglik", "_before"), "cb").select("cb", F.lit(cycle).alias("cycles"), (gain < tolerance).alias("converged"), "loglik", gain.alias("increment")))
        settled = stats if cycle == cycles else stats.where("converged")
        for old in (part, shares, rows, loglik):
            drop_cut(old)
        if not settled.isEmpty():
            done.append((cut(new.join(settled.select("cb"), "cb", "left_semi")), cut(settled)))
            going = stats.join(settled.select("cb"), "cb", "left_anti").select("cb", "loglik")
            kept = going.select("cb")
            cells, shares, rows = (cut(t.join(kept, "cb", "left_semi")) for t in (cells, new, new_rows))
            loglik = cut(going)
        else:
            shares, rows, loglik = new, new_rows, cut(stats.select("cb", "loglik"))
        if loglik.isEmpty():
            break
    first = shares.select("cb", "feature_id", "p").limit(0), stats.limit(0)
    for p, s in done:
        first = first[0].unionByName(p), first[1].unionByName(s)
    return first


def _numbered_sets(sets: DataFrame, names: DataFrame) -> DataFrame:
    """(cb, codes, weight): the sets with the numbers of their features."""
    rows = cut(sets.select("cb", F.monotonically_increasing_id().alias("row"), "features", "weight"))
    cells = rows.select("cb", "row", F.explode("features").alias("feature_id"), "weight").join(names, ["cb", "feature_id"])
    return cut(cells.groupBy("cb", "row").agg(F.collect_list("code").alias("codes"), F.any_value("weight").alias("weight")).select("cb", "codes", "weight"))


def _cycle(coded: DataFrame, shares: DataFrame) -> DataFrame:
    """(cb, shares, loglik): the shares after a cycle from (cb, shares), and the log-likelihood before it. Written."""
    rows = coded.join(F.broadcast(shares), "cb").select("cb", "codes", "weight", F.transform("codes", lambda c: F.get("shares", c)).alias("w"))
    rows = rows.select("cb", "codes", "weight", "w", F.aggregate("w", F.lit(0.0), lambda a, x: a + x).alias("s"))
    parts = F.transform(F.arrays_zip("codes", "w"), lambda z: F.struct(z["codes"].alias("code"), (F.col("weight") * z["w"] / F.col("s")).alias("v")))
    own = F.array(F.struct(F.lit(-1).alias("code"), (F.col("weight") * F.log(F.col("s") + F.lit(EPS))).alias("v")))
    sums = rows.select("cb", F.explode(F.concat(own, parts)).alias("x")).groupBy("cb", F.col("x.code").alias("code")).agg(F.sum("x.v").alias("v"))
    total = F.sum(F.when(F.col("code") >= 0, F.col("v")))
    cells = sums.groupBy("cb").agg(F.array_sort(F.collect_list(F.struct("code", "v"))).alias("all"), total.alias("total"))
    new = F.transform(F.filter("all", lambda x: x["code"] >= 0), lambda x: x["v"] / F.col("total"))
    return cut(cells.select("cb", new.alias("shares"), F.col("all")[0]["v"].alias("loglik")))


def settle(sets: DataFrame, cycles: int, tolerance: float, *, most: int = SHARES) -> tuple[DataFrame, DataFrame]:
    """As ``em_until_settled``, of the sets (cb, features, weight). With a tolerance below 0 all cycles are made."""
    names = sets.select("cb", F.explode("features").alias("feature_id")).distinct()
    names = cut(names.withColumn("code", F.row_number().over(Window.partitionBy("cb").orderBy("feature_id")) - 1))
    if names.count() > most:
        rows = cut(sets.select("cb", F.monotonically_increasing_id().alias("row"), "features", "weight"))
        return em_until_settled(rows.select("cb", "row", F.explode("features").alias("feature_id"), "weight"), cycles, tolerance)
    coded = _numbered_sets(sets, names)
    n = F.count(F.lit(1))
    shares = names.groupBy("cb").agg(F.array_repeat(F.lit(1.0) / n, n.cast("int")).alias("shares"))
    ahead = _cycle(coded, shares)  # a cycle ahead, as it also tells the log-likelihood of where it began
    done: list[tuple[DataFrame, DataFrame]] = []
    for cycle in range(1, cycles + 1):
        now, ahead = ahead, _cycle(coded, ahead.select("cb", "shares"))
        gain = F.abs(F.col("loglik") - F.col("_before"))
        stats = ahead.select("cb", "loglik").join(now.select("cb", F.col("loglik").alias("_before")), "cb")
        stats = cut(stats.select("cb", F.lit(cycle).alias("cycles"), (gain < tolerance).alias("converged"), "loglik", gain.alias("increment")))
        settled = stats if cycle == cycles else stats.where("converged")
        if not settled.isEmpty():
            done.append((cut(now.join(settled.select("cb"), "cb", "left_semi").select("cb", "shares")), settled))
            ahead = cut(ahead.join(settled.select("cb"), "cb", "left_anti"))
            if ahead.isEmpty():
                break
        drop_cut(now)
    held, kept = ahead.select("cb", "shares").limit(0), stats.limit(0)
    for p, s in done:
        held, kept = held.unionByName(p), kept.unionByName(s)
    return held.select("cb", F.posexplode("shares").alias("code", "p")).join(names, ["cb", "code"]).select("cb", "feature_id", "p"), kept
