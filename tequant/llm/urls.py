"""URL filter: a trie over reversed host labels and path characters decides by the longest fitting rule.

A rule is (verdict, host, path): it fits the host and its subdomains if the url's path starts with the rule's path. Of the rules
that fit, the one with the longest ``host + path`` wins; of two equally long ones, ``block``. Urls that no rule fits get
``default``.

The trie is broadcast only while the rules stay below RULES_BOUND bytes; larger rule sets are joined to the urls by host suffix.

Defined cases: a null url, and one without ``://``, has empty host and path and so gets the default; repeated rules count once;
repeated rows are judged each for itself; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tequant.llm.common import ascii_lower

RULES_BOUND = 64 << 20


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str = "/"


def url_parts(docs: DataFrame, *carry: str, url: str = "url") -> DataFrame:
    """Adds host (A-Z lower-cased) and path, both empty where the url has no ``://``."""
    rest = F.when(F.instr(F.col(url), "://") > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return docs.select(*carry, ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0)).alias("host"), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1).alias("path"))


class HostPathTrie:
    """Children by reversed host label; at each host the paths of its rules, cut after every slash, the rest as a prefix."""

    def __init__(self, rules: Iterable[Rule]):
        self.top: dict = {}
        for r in sorted(set(rules), key=lambda r: r.verdict == "block"):  # of equal rules the block entry is put last and stays
            node = self.top
            for label in reversed(r.host.lower().split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault("", {})  # no label is empty in a rule's host
            *whole, rest = r.path.split("/")
            for segment in whole:
                node = node.setdefault(segment, {})
            node.setdefault(None, {})[rest] = r

    def match(self, host: str, path: str) -> Rule | None:
        best, node = None, self.top
        for label in reversed(host.split(".")):
            node = node.get(label) if label else None
            if node is None:
                break
            if "" in node:
                best = self._longer(best, self._paths(node[""], path))
        return best

    @staticmethod
    def _longer(a: Rule | None, b: Rule | None) -> Rule | None:
        if a is None or b is None:
            return a or b
        return max(a, b, key=lambda r: (len(r.host) + len(r.path), r.verdict == "block"))

    @staticmethod
    def _paths(node: dict, path: str) -> Rule | None:
        best = None
        for segment in path.split("/"):
            for rest, rule in node.get(None, {}).items():
                if segment.startswith(rest) and (best is None or len(rule.path) > len(best.path)):
                    best = rule
            node = node.get(segment)
            if node is None:
                break
        return best


def judge(docs: DataFrame, rules: Iterable[Rule], *, key: str, url: str = "url", default: str = "allow", bound: int = RULES_BOUND) -> DataFrame:
    """Per row: key, host, path, rule (host + path, or null) and verdict."""
    rules = list(rules)
    parts = url_parts(docs, key, url=url)
    if sum(200 + len(r.host) + len(r.path) for r in rules) > bound:
        return _judge_by_join(docs, rules, key, url, default)
    trie = docs.sparkSession.sparkContext.broadcast(HostPathTrie(rules))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = trie.value
        for b in batches:
            found = [t.match(h, p) for h, p in zip(b["host"], b["path"], strict=True)]
            yield b.assign(rule=[r and r.host + r.path for r in found], verdict=[r.verdict if r else default for r in found])

    kind = dict(parts.dtypes)[key]
    return parts.mapInPandas(run, f"`{key}` {kind}, host string, path string, rule string, verdict string")


def _judge_by_join(docs: DataFrame, rules: list[Rule], key: str, url: str, default: str) -> DataFrame:
    """The same by an equi-join on every host suffix, for rule sets that are too large to broadcast. Urls of one host and path are judged
    once, and rows meet their verdict by both."""
    spark = docs.sparkSession
    table = spark.createDataFrame([(r.verdict, r.host.lower(), r.path) for r in set(rules)] or [("allow", "", "")], "r_verdict string, r_host string, r_path string")
    parts = url_parts(docs, key, url=url)
    n = F.size(F.split("host", "\\."))
    tails = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(F.split("host", "\\."), i, n), "."))
    hits = parts.select("host", "path").distinct().select("host", "path", F.explode(F.array_distinct(tails)).alias("r_host")).join(table, "r_host").where(F.col("path").startswith(F.col("r_path")))
    rank = F.struct(F.length("r_host") + F.length("r_path"), F.col("r_verdict") == "block", F.concat("r_host", "r_path"), "r_verdict")
    best = hits.groupBy("host", "path").agg(F.max(rank).alias("b")).select("host", "path", F.col("b.col3").alias("rule"), F.col("b.r_verdict").alias("verdict"))
    return parts.join(best, ["host", "path"], "left").select(key, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
