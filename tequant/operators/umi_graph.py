"""The graph of UMIs that may stem from each other by a sequencing error.

Two classes of a cell whose UMIs differ in at most one place agree once that place is blanked, so pairs come from an equi-join on (cell,
UMI with one place blanked): every row of the join is a pair, and no stretch of letters that many UMIs share makes a hot key. Equal UMIs
meet under every place and are kept under the first. UMIs of different lengths are compared up to the end of the shorter one: each is
entered under the lengths of its cell that it reaches, and a pair counts under the shorter one's.

Pairs are as many as they are, but nothing of their number is shuffled or held: candidates come from lists of classes of one UMI, LIST at
most, and links are judged where a pair is met, by features that came along with the places. What asks only whether a class has a
link is answered from sums by (place, feature) without any pair, and what asks for components alone gets links that bind the same classes
together, one for each class and feature.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tequant.operators import kernel
from tequant.operators.mappings import BESIDE
from tequant.staging import cut, waves

BLANK = "_"
LIST = 4096
PLACE = ["cb", "l", "place", "key"]


def _blanked(rows: DataFrame, *carry: str) -> DataFrame:
    """(cb, size, l, letter, place, key) and ``carry``: the UMI of each row, cut to each length it reaches, under each of its places."""
    lengths = cut(rows.groupBy("cb").agg(F.collect_set(F.length("umi")).alias("lengths")))  # a few per cell
    lengths = F.broadcast(lengths) if lengths.count() <= BESIDE else lengths  # so that no cell's classes go to one task to learn them
    reached = F.explode(F.filter("lengths", lambda n: n <= F.length("umi")))
    rows = rows.select("cb", "umi", *carry).join(lengths, "cb").select("cb", "umi", *carry, F.length("umi").alias("size"), reached.alias("l"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.greatest("l", F.lit(1)))).alias("place"))
    key = F.concat(F.substring("umi", F.lit(1), F.col("place") - 1), F.lit(BLANK), F.substring(F.col("umi"), F.col("place") + 1, F.col("l") - F.col("place")))
    return rows.select("cb", "size", "l", F.substring("umi", F.col("place"), F.lit(1)).alias("letter"), "place", key.alias("key"), *carry)


def _met(keys: DataFrame, *carry: str) -> DataFrame:
    """Pairs of rows that meet, under one place alone; the columns of the sides begin with i_ and j_."""
    side = lambda p: keys.select(*PLACE, *(F.col(c).alias(f"{p}_{c}") for c in ("size", "letter", *carry)))
    return side("i").join(side("j"), PLACE).where((F.col("l") == F.least("i_size", "j_size")) & ((F.col("place") == 1) | (F.col("i_letter") != F.col("j_letter"))))


def candidate_pairs(ecs: DataFrame) -> DataFrame:
    """(cb, i, j), i < j: pairs with one differing letter at most."""
    lists = ecs.groupBy("cb", "umi", F.floor(F.col("ec_index") / LIST).alias("_list")).agg(F.collect_list("ec_index").alias("classes"), F.min("ec_index").alias("first"))
    met = _met(_blanked(lists, "classes", "first"), "classes", "first").where("i_first <= j_first")
    pairs = met.select("cb", (F.col("i_first") == F.col("j_first")).alias("same"), F.explode("i_classes").alias("a"), "j_classes").select("cb", "same", "a", F.explode("j_classes").alias("b"))
    return pairs.where("NOT same OR a < b").select("cb", F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"))


def _signs(of: int) -> Column:
    """64 bits, one for each feature by its hash; classes with a common feature have a common bit."""
    bit = lambda f: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(f, F.lit(of)), F.lit(64)).cast("int"))
    return F.aggregate("features", F.lit(0).cast("long"), lambda s, f: s.bitwiseOR(bit(f)))


def edges(ecs: DataFrame) -> DataFrame:
    """(cb, src, dst): src may have given rise to dst: one error at most, a common feature, and 2 * dst - 1 reads or more."""
    carry = ("ec_index", "read_count", "signs", "more_signs", "features")
    rows = ecs.select("cb", "umi", "ec_index", "read_count", _signs(0).alias("signs"), _signs(1).alias("more_signs"), "features")
    pairs = _met(_blanked(rows, *carry), *carry).where("i_ec_index < j_ec_index")
    pairs = pairs.where("(i_signs & j_signs) <> 0").where("(i_more_signs & j_more_signs) <> 0")
    pairs = pairs.where("i_read_count >= 2 * j_read_count - 1 OR j_read_count >= 2 * i_read_count - 1").where(F.arrays_overlap("i_features", "j_features"))
    ends = lambda a, b: F.when(F.col(f"{a}_read_count") >= 2 * F.col(f"{b}_read_count") - 1, F.struct(F.col(f"{a}_ec_index").alias("src"), F.col(f"{b}_ec_index").alias("dst")))
    return pairs.select("cb", F.explode(F.array_compact(F.array(ends("i", "j"), ends("j", "i")))).alias("e")).select("cb", "e.src", "e.dst")


def _bind(pdf: pd.DataFrame) -> pd.DataFrame:
    """(cb, src, dst) from the least class of each component of a cell's classes with a feature to its other classes."""
    pdf = pdf.sort_values("ec_index")
    index = pdf["ec_index"].to_numpy()
    top = index[kernel.bound(pdf["umi"].tolist(), pdf["read_count"].to_numpy())]
    return pd.DataFrame({"cb": pdf["cb"].iloc[0], "src": top, "dst": index})[top != index]


def binding_links(ecs: DataFrame) -> DataFrame:
    """(cb, src, dst), with the same weak components as ``edges`` and no more rows than classes have features. A group is the classes of a
    cell with one feature, and its work is in proportion to its rows."""
    rows = ecs.select("cb", F.explode(F.array_distinct("features")).alias("feature"), "ec_index", "umi", "read_count")
    return rows.repartition(waves(ecs.sparkSession), "cb", "feature").groupBy("cb", "feature").applyInPandas(_bind, "cb string, src int, dst int")


def parents(ecs: DataFrame) -> DataFrame:
    """(cb, ec_index) of the classes that no other class may have given rise to.

    A class of n > 1 reads has a link from another if the most reads of a class with one of its features, under one of its places, are
    2 * n - 1 or more, as its own are fewer; a class of one read if any other is there. A UMI that is longer than the place's length
    meets only those of that length.
    """
    sets = ecs.select("cb", "umi", "ec_index", "read_count", F.explode("features").alias("feature"))
    most = cut(sets.groupBy("cb", "umi", "feature").agg(F.count(F.lit(1)).alias("n"), F.max("read_count").alias("top")))
    keys, own = _blanked(most.withColumn("of", F.col("umi")), "of", "feature", "n", "top"), F.col("size") == F.col("l")
    short = lambda c: F.when(own, F.col(c))
    there = keys.groupBy(*PLACE, "feature").agg(F.sum("n").alias("all_n"), F.max("top").alias("all_top"), F.coalesce(F.sum(short("n")), F.lit(0)).alias("own_n"), F.max(short("top")).alias("own_top"))
    met = keys.select(*PLACE, "feature", "of", "size").join(there, [*PLACE, "feature"])
    met = met.groupBy("cb", F.col("of").alias("umi"), "feature").agg(F.max(F.when(own, F.col("all_n") - 1).otherwise(F.col("own_n"))).alias("others"), F.max(F.when(own, F.col("all_top")).otherwise(F.col("own_top"))).alias("top"))
    entered = sets.join(met, ["cb", "umi", "feature"]).where("(read_count = 1 AND others > 0) OR (read_count > 1 AND top >= 2 * read_count - 1)")
    return ecs.select("cb", "ec_index").join(entered.select("cb", "ec_index").distinct(), ["cb", "ec_index"], "left_anti")
