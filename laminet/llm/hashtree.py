"""Sharding by a hierarchical weighted hash tree, with DataFrame functions only.

A tree has regions, these racks, these shards; a node weighs what its shards weigh. A document descends level by level:
among a node's children it takes the one with the least draw, -ln(u) / weight, where u is a hash of the document's id
and the child's name. A child whose weight doesn't change keeps its draws, so a change of weights moves documents only
into, out of and within the subtrees whose weights changed. A shard added by grow() is a branch of its own, a new region
with one rack, so that it takes documents only into itself.

Cases: a null id is hashed as a fixed string; a null text has no bytes (size is the overhead, its checksum that of empty
bytes); repeated rows go to the same shard and get slots of their own; an empty table gives an empty one.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from laminet.llm.common import own_name

OVERHEAD = 16
#: Rows that one sorted run of a shard's numbering holds, on average.
RUN_ROWS = 50_000


@dataclass(frozen=True)
class Tree:
    """places: for each shard its (region, rack, weight); racks are numbered throughout."""

    places: tuple[tuple[int, int, float], ...]

    @staticmethod
    def even(shards: int = 40, shards_a_rack: int = 5, racks_a_region: int = 2) -> Tree:
        return Tree(tuple((s // (shards_a_rack * racks_a_region), s // shards_a_rack, 1.0) for s in range(shards)))

    def grow(self, weight: float = 1.0) -> Tree:
        """With one more shard, in a new rack of a new region."""
        return Tree((*self.places, (max(p[0] for p in self.places) + 1, max(p[1] for p in self.places) + 1, weight)))

    def reweigh(self, shard: int, weight: float) -> Tree:
        return Tree(tuple((r, k, weight if s == shard else w) for s, (r, k, w) in enumerate(self.places)))

    def regions(self) -> list[tuple[int, float]]:
        return _summed((r, w) for r, _, w in self.places)

    def racks(self) -> dict[int, list[tuple[int, float]]]:
        return {r: _summed((k, w) for q, k, w in self.places if q == r) for r, _ in self.regions()}

    def shards(self) -> dict[int, list[tuple[int, float]]]:
        return {k: [(s, w) for s, (_, q, w) in enumerate(self.places) if q == k] for k in {p[1] for p in self.places}}


def _summed(pairs) -> list[tuple[int, float]]:
    out: dict[int, float] = {}
    for k, w in pairs:
        out[k] = out.get(k, 0.0) + w
    return sorted(out.items())


def uniform(key: Column, name: Column) -> Column:
    """From above 0 to 1, of 48 bits of a hash of the key and a node's name."""
    return (F.conv(F.substring(F.md5(F.concat_ws("/", key, name)), 1, 12), 16, 10).cast("long") + F.lit(1)) / F.lit(float(2**48))


def _least(key: Column, level: str, children: Column) -> Column:
    """children: array of struct(node, weight). The node with the least draw; ties to the lower number."""
    drawn = F.transform(children, lambda c: F.struct((-F.ln(uniform(key, F.concat(F.lit(level), c["node"].cast("string")))) / c["weight"]).alias("d"), c["node"].alias("node")))
    return F.array_min(drawn)["node"]


def _of(children: dict[int, list[tuple[int, float]]], parent: Column) -> Column:
    entry = lambda pairs: F.array(*[F.struct(F.lit(n).alias("node"), F.lit(w).alias("weight")) for n, w in pairs])
    return F.element_at(F.array(*[entry(children[k]) for k in sorted(children)]), parent + 1)


def descend(df: DataFrame, key: Column, tree: Tree, out: str = "shard") -> DataFrame:
    """Adds the shard, a column of that name. key: string."""
    r, k = own_name(df, f"{out}_region"), own_name(df, f"{out}_rack")
    df = df.withColumn(r, _least(key, "region", _of({0: tree.regions()}, F.lit(0))))
    df = df.withColumn(k, _least(key, "rack", _of(tree.racks(), F.col(r))))
    return df.withColumn(out, _least(key, "shard", _of(tree.shards(), F.col(k)))).drop(r, k)


def slots(df: DataFrame, shard: str, order: list[Column], rows: int, out: str = "slot", run_rows: int = RUN_ROWS) -> DataFrame:
    """Adds a number from 0 on within each shard, without a gap.

    A shard's rows are dealt into runs by a hash; a run is numbered by itself, after the counts of the runs before it.
    The counts have one row for each shard and run.
    """
    runs = max(1, math.ceil(rows / run_rows))
    run = own_name(df, "_run")
    df = df.withColumn(run, F.pmod(F.xxhash64(*order), F.lit(runs)))
    counts = df.groupBy(shard, run).agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(shard).orderBy(run).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    numbered = df.withColumn("_k", F.row_number().over(Window.partitionBy(shard, run).orderBy(*order)))
    return numbered.join(before, [shard, run]).withColumn(out, (F.col("_before") + F.col("_k") - 1).cast("long")).drop("_before", "_k", run)


def assign(docs: DataFrame, tree: Tree, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32 long, shard int, slot long, grown_shard int (with one more shard of weight 1)."""
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(body) + OVERHEAD).cast("long").alias("size"), F.crc32(body).cast("long").alias("text_crc32"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    rows = descend(descend(rows, key, tree), key, tree.grow(), "grown_shard")
    return slots(rows, "shard", [F.col("doc_id"), F.col("size"), F.col("text_crc32")], docs.count())
