"""URL filters by a sort-merge range join of rules and urls.

A host's canonical key is its labels in reverse, each with a dot after it, so a rule for a host and all its subdomains is
the interval of keys from the host's own key to that key with its last dot raised by one. Urls are dealt to ranges of (key,
path, hash of the id) with bounds from a bounded sample, so that one hot host or url fills several ranges; a rule goes to
every range that its interval meets. In each range one sweep over rules and urls in key order keeps a stack of the rule
hosts whose intervals hold the current key; they are nested. A url takes the longest rule of the stack whose path starts
its own.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

#: Verdict, rule.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Urls sampled for each range.
SAMPLED = 64


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a url; both '' for null and without '://'."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """(verdict, rule) rows of a short list."""
    return spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(v).alias("verdict"), F.lit(r).alias("rule")) for v, r in rules])))


class Node:
    """A host on the stack: where its interval ends, and its rules by path."""

    def __init__(self, key: str):
        self.key, self.end, self.by_path, self.lengths = key, key[:-1] + "/", {}, []

    def add(self, path: str, rule: str, verdict: str) -> None:
        if path not in self.by_path:
            self.lengths = sorted({len(path), *self.lengths}, reverse=True)
        elif verdict != "block":
            return
        self.by_path[path] = (rule, verdict)

    def longest(self, path: str) -> tuple[str, str] | None:
        for n in self.lengths:
            if n <= len(path) and (found := self.by_path.get(path[:n])):
                return found
        return None


def _sweep(default: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[Node] = []
        place = None
        for batch in batches:
            out = []
            for part, key, kind, page, host, path, rule, verdict in zip(*(c.to_pylist() for c in batch.columns)):
                if part != place:
                    stack, place = [], part
                while stack and key >= stack[-1].end:
                    stack.pop()
                if kind == 0:
                    if not stack or stack[-1].key != key:
                        stack.append(Node(key))
                    stack[-1].add(path, rule, verdict)
                    continue
                fits = [f for node in reversed(stack) if (f := node.longest(path))]
                won = max(fits, key=lambda f: len(f[0]), default=(None, default))
                out.append((page, host, path, *won))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 5, [pa.int64()] + [pa.string()] * 4)], names=["id", "host", "path", "rule", "verdict"])

    return run


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", ranges: int | None = None) -> DataFrame:
    """(id_col, host, path, rule, verdict), a row for each row of pages, repeated rows and null ids included.

    rules: (verdict, rule), a rule being a host, a slash and more of a path, which fits the host and all its subdomains if
    the url's path starts with the rule's. The longest rule that fits wins; of equal rules 'block' wins. Without a rule
    that fits, rule is null and the verdict ``default``. Null rules and rules without a host are left out. Null
    urls and urls without '://' have an empty host and path, which no rule fits. Other columns of pages are ignored, whatever
    their names; an empty table gives no rows. The pages are counted and sampled for the ranges at once.
    """
    spark = pages.sparkSession
    url_host, url_path = parts(F.col(url_col).cast("string"))
    urls = pages.select(F.col(id_col).cast("long").alias("id"), url_host.alias("host"), url_path.alias("path"))
    urls = urls.withColumn("key", host_key(F.col("host"))).withColumn("spread", F.xxhash64("id"))
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    fraction = min(1.0, SAMPLED * ranges / max(1, urls.count()))
    sample = sorted(tuple(r) for r in urls.select("key", "path", "spread").sample(fraction, 7).collect())
    bounds = spark.sparkContext.broadcast([sample[k * len(sample) // ranges] for k in range(1, ranges)] if sample else [])

    def deal(key: pa.Array, path: pa.Array, spread: pa.Array) -> pa.Array:
        return pa.array([bisect_right(bounds.value, x) for x in zip(key.to_pylist(), path.to_pylist(), spread.to_pylist())], pa.int32())

    deal.__annotations__ = {"key": pa.Array, "path": pa.Array, "spread": pa.Array, "return": pa.Array}
    part = F.arrow_udf(deal, T.IntegerType())
    rules = rules.filter(F.locate("/", "rule") > 1).select("verdict", "rule", F.translate(F.substring_index("rule", "/", 1), UPPER, LOWER).alias("host"))
    rules = rules.withColumn("path", F.expr("substring(rule, length(host) + 1)")).withColumn("key", host_key(F.col("host")))
    low, end = F.lit(-(2**63)), F.expr("concat(substring(key, 1, length(key) - 1), '/')")
    rules = rules.withColumn("a", part("key", F.lit(""), low)).withColumn("b", part(end, F.lit(""), low))
    rules = rules.select(F.explode(F.sequence("a", "b")).alias("part"), "key", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("id"), "host", "path", "rule", "verdict")
    none = F.lit(None).cast("string")
    rows = urls.select(part("key", "path", "spread").alias("part"), "key", F.lit(1).alias("kind"), "id", "host", "path", none.alias("rule"), none.alias("verdict"))
    rows = rows.unionByName(rules).repartition(ranges, "part").sortWithinPartitions("part", "key", "kind", "path", "verdict")
    out = rows.mapInArrow(_sweep(default), "id long, host string, path string, rule string, verdict string")
    return out.withColumnRenamed("id", id_col)
