"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source is due the same fractional number of copies, the source's target over its size. The whole
part is given; the fractional parts are rounded so that the words taken stay at the target: two documents meet, mass in
words passes from one to the other, in the direction that a draw decides with the odds that keep both expectations,
until one of them is at none or one whole copy; the other goes on to meet the next. What is left of a block is one document; the
blocks' residuals meet in blocks again, up a tree, until one document of each source is left, which a last draw settles.
Within a block, long documents come first, and each is paired with the pool of all shorter ones, whose fractions are still equal: a draw makes it
none or one whole copy, and the pool takes up the words that this gives or takes. From where the pool couldn't take up either outcome, and for
residuals, documents meet in pairs. So what a source leaves open at last is a short
document, and each document gets either of the two whole numbers about its due.

Draws are hashes of the document, its level and SEED, blocks are hashes of the document, and rows of a block are sorted, so that reruns agree
however the rows are dealt out. A hot source is only more blocks.

Cases: a null text has no words; null sources are one source, sorted last; documents of no words get the whole part of
their due (they weigh nothing) and no more; repeated rows are separate documents; an empty table gives an empty one; a
due of 0 or a whole number needs no rounding.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from laminet.llm.common import cut

WEIGHTS = (5.0, 2.0, 1.0)
MOST_COPIES = 3
SEED = 20240517
#: Documents that one task of the tree holds at once, on average.
BLOCK = 2048


def words(text: Column) -> Column:
    """Number of runs of other characters than the space and U+0009 to U+000D."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_COPIES) -> DataFrame:
    """sources: (source, source_size long, one row each). Adds target double.

    Raising all uncapped targets together in proportion to their weights until they use up the total, each stopping at
    its cap, is what resharing the excess over and over comes to. With the sources in the order in which they would
    reach their caps, the level is found from running sums.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    rows = sources.withColumn("_w", w).withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    rise = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").isNull(), F.col("source").cast("binary"))
    everything = Window.partitionBy()
    rows = rows.withColumns(
        {
            "_full": F.coalesce(F.sum("_cap").over(rise.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
            "_open": F.sum("_w").over(rise.rowsBetween(0, Window.unboundedFollowing)),
            "_total": F.sum("source_size").over(everything).cast("double"),
            "_k": F.row_number().over(rise),
        }
    )
    # The level if this source and all after it are open; it holds if this one's cap isn't reached, so the first such counts.
    level = (F.col("_total") - F.col("_full")) / F.col("_open")
    rows = rows.withColumn("_level", F.min(F.when(level * F.col("_w") <= F.col("_cap"), F.struct(F.col("_k"), level.alias("l")))).over(everything)["l"])
    target = F.when(F.col("_level").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_level") * F.col("_w")))
    return rows.withColumn("target", target).drop("_w", "_cap", "_full", "_open", "_total", "_k", "_level")


def pooled(size: np.ndarray, p: np.ndarray, draw: np.ndarray) -> None:
    """Makes p whole, longest documents first, as far as the pool of those after it, of one common fraction, can take up the difference."""
    at = np.flatnonzero((p > 0.0) & (p < 1.0))
    if len(at) < 2 or np.ptp(p[at]) > 1e-12:
        return
    rest, x = np.cumsum(size[at][::-1])[::-1] - size[at], float(p[at[0]])
    done = 0
    for s, pool, u in zip(size[at].tolist(), rest.tolist(), draw[at].tolist(), strict=True):
        if pool <= 0:
            break
        one, none = x - (1 - x) * s / pool, x + x * s / pool  # the pool's fraction after either outcome
        if one < 0 or none > 1:
            break
        up = u < x
        p[at[done]], x = float(up), one if up else none
        done += 1
    p[at[done:]] = min(1.0, max(0.0, x))


def settle(size: np.ndarray, p: np.ndarray, draw: np.ndarray, last: bool) -> tuple[np.ndarray, int]:
    """Rounds p in order, keeping sum(p * size). Returns the 0s and 1s, and which one is left open (-1 if none).

    draw: a number from 0 to 1 for each document, used when it meets the one that is open.
    """
    out = np.zeros(len(p), np.int64)
    pooled(size, p, draw)
    open_at, q = -1, 0.0
    for i, (s, x, u) in enumerate(zip(size.tolist(), p.tolist(), draw.tolist(), strict=True)):
        if x <= 0.0 or x >= 1.0:
            out[i] = x >= 1.0
            continue
        if open_at < 0:
            open_at, q = i, x
            continue
        t = float(size[open_at])
        up = min((1 - x) * s, q * t)  # words that may pass to i
        down = min(x * s, (1 - q) * t)  # words that i may give
        step = up if u * (up + down) < down else -down
        x, q = x + step / s, q - step / t
        # One of the two is whole now, but for rounding errors.
        far = lambda v: min(v, 1 - v)
        if far(q) <= far(x):
            out[open_at] = round(q)
            open_at, q = (i, x) if far(x) > 1e-9 else (-1, 0.0)
            if open_at < 0:
                out[i] = round(x)
        else:
            out[i] = round(x)
            if far(q) <= 1e-9:
                out[open_at], open_at = round(q), -1
    p_left = q
    if open_at >= 0:
        p[open_at] = p_left
        if last:
            out[open_at] = int(draw[open_at] * 7919.0 % 1.0 < p_left)  # other digits than those used
            open_at = -1
    return out, open_at


def _rounding(last: bool):
    def run(g):
        g = g.sort_values(["size", "_u", "_id"], ascending=[False, True, True], kind="stable", ignore_index=True)
        p = g["_p"].to_numpy(copy=True)
        extra, left = settle(g["size"].to_numpy(float), p, g["_u"].to_numpy(), last)
        g["_p"], g["_extra"] = p, extra
        g["_left"] = np.arange(len(g)) == left
        return g.drop(columns="_u")

    return run


def _uniform(level: int) -> Column:
    return F.xxhash64("_id", "size", F.lit(SEED), F.lit(level)) / F.lit(2.0**64) + 0.5


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES, block: int = BLOCK) -> DataFrame:
    """One row for each document: doc_id, source, size, source_size long, target double (of its source), copies long."""
    sized = cut(docs.select(F.col(doc_id).alias("_id"), F.col(source).alias("source"), words(F.col(text)).alias("size")), "sizes")
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_n"))
    per = cut(targets(per, weights, most), "targets")
    due = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    # A table of one row a source goes by the join that Spark finds fit; a hot source is split there.
    rows = sized.join(per.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    rows = rows.withColumn("_due", due).withColumns({"_whole": F.floor("_due").cast("long"), "_p": F.col("_due") - F.floor("_due")})
    rows = rows.withColumn("_p", F.when((F.col("size") == 0) | (F.col("_p") < 1e-12), 0.0).when(F.col("_p") > 1 - 1e-12, 1.0).otherwise(F.col("_p")))
    rows = rows.withColumn("_blocks", F.greatest(F.lit(1), F.ceil(F.col("_n") / block)).cast("long"))
    rows = rows.withColumn("_block", F.pmod(F.xxhash64("_id", F.lit(SEED)), F.col("_blocks")))
    fields = "_id {}, source string, size long, source_size long, target double, _whole long, _p double, _blocks long, _block long, _extra long, _left boolean".format(dict(docs.dtypes)[doc_id])
    done, level = [], 0
    most_blocks = int(per.agg(F.max(F.ceil(F.col("_n") / block))).first()[0] or 1)
    while True:
        last = most_blocks <= 1

        got = rows.select("_id", "source", "size", "source_size", "target", "_whole", "_p", "_blocks", "_block").withColumn("_u", _uniform(level))
        got = cut(got.groupBy("source", "_block").applyInPandas(_rounding(last), fields), f"mix{level}")
        done.append(got.where(~F.col("_left")))
        if last:
            break
        # Residuals: one of a block at most; up to `block` blocks' residuals meet in one task of the next level.
        most_blocks = -(-most_blocks // block)
        level += 1
        rows = got.where("_left").withColumns({"_blocks": F.greatest(F.lit(1), F.ceil(F.col("_blocks") / block)).cast("long")}).withColumn("_block", F.pmod(F.col("_block"), F.col("_blocks")))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select(F.col("_id").alias(doc_id), "source", "size", "source_size", "target", (F.col("_whole") + F.col("_extra")).alias("copies"))
