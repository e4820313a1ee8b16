"""Data for drawing: force layout, offsets of layers, node sizes, colours and curves. Nothing is rendered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from laminet.operators.iterate import names_of
from laminet.session import cut


def minmax(df: DataFrame, cols: tuple[str, ...] = ("x", "y"), by: list[str] | None = None) -> DataFrame:
    """Columns moved and scaled to 0 to 1 (0.5 where all are equal)."""
    w = Window.partitionBy(*(by or []))
    out = {c: F.when(F.max(c).over(w) > F.min(c).over(w), (F.col(c) - F.min(c).over(w)) / (F.max(c).over(w) - F.min(c).over(w))).otherwise(0.5) for c in cols}
    return df.withColumns(out)


def random_layout(nodes: DataFrame, seed: int = 1) -> DataFrame:
    u = lambda k: F.xxhash64("node", F.lit(seed), F.lit(k)) / F.lit(2.0**64) + 0.5
    return nodes.select("node", u(0).alias("x"), u(1).alias("y"))


def force_layout(edges: DataFrame, steps: int = 30, scaling: float = 2.0, gravity: float = 1.0, grid: int = 8, exact_below: int = 500, seed: int = 1) -> DataFrame:
    """(node, x, y): attraction along edges, repulsion by mass (1 + degree) over distance, gravity to the centre, and steps that shrink.

    With few nodes all repel each other; with more, nodes are repelled by those of their own grid cell's centre of mass and by the centres of
    all other cells, of which there are at most grid x grid."""
    e = cut(edges.where("src <> dst").groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.sum("weight").alias("weight")), "edges")
    both = e.select("src", "dst", "weight").union(e.select("dst", "src", "weight"))
    mass = names_of(e).join(both.groupBy(F.col("src").alias("node")).agg((1.0 + F.count("*")).alias("mass")), "node", "left").fillna(1.0, ["mass"])
    now = cut(random_layout(mass, seed).join(mass, "node"), "layout")
    n = now.count()
    for k in range(steps):
        if n <= exact_below:
            centres = now.select(F.col("x").alias("cx"), F.col("y").alias("cy"), F.col("mass").alias("cm"))
        else:
            box = minmax(now.select("node", "x", "y", "mass", F.col("x").alias("bx"), F.col("y").alias("by")), ("bx", "by"))
            cell = [F.least(F.lit(grid - 1), F.floor(F.col(c) * grid)) for c in ("bx", "by")]
            centres = box.groupBy(*cell).agg((F.sum(F.col("x") * F.col("mass")) / F.sum("mass")).alias("cx"), (F.sum(F.col("y") * F.col("mass")) / F.sum("mass")).alias("cy"), F.sum("mass").alias("cm")).select("cx", "cy", "cm")
        every = centres.agg(F.collect_list(F.struct("cx", "cy", "cm")).alias("cs")).withColumn("_j", F.lit(0))
        push = now.withColumn("_j", F.lit(0)).join(F.broadcast(every), "_j")

        def force(axis: str, centre: str, cs: Column = F.col("cs")) -> Column:
            def one(acc, c):
                dx, dy = F.col("x") - c["cx"], F.col("y") - c["cy"]
                d2 = dx * dx + dy * dy
                return acc + F.when(d2 > 1e-12, scaling * F.col("mass") * c["cm"] * (F.col(axis) - c[centre]) / F.when(d2 > 1e-12, d2)).otherwise(0.0)

            return F.aggregate(cs, F.lit(0.0), one)

        r = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))
        pull = lambda axis: F.when(r > 1e-12, gravity * F.col("mass") * F.col(axis) / F.when(r > 1e-12, r)).otherwise(0.0)
        push = push.select("node", "x", "y", "mass", (force("x", "cx") - pull("x")).alias("fx"), (force("y", "cy") - pull("y")).alias("fy"))
        at = now.select(F.col("node").alias("dst"), F.col("x").alias("x2"), F.col("y").alias("y2"))
        drawn = both.join(now.select(F.col("node").alias("src"), "x", "y"), "src").join(at, "dst").groupBy(F.col("src").alias("node")).agg(F.sum(F.col("weight") * (F.col("x2") - F.col("x"))).alias("ax"), F.sum(F.col("weight") * (F.col("y2") - F.col("y"))).alias("ay"))
        moved = push.join(drawn, "node", "left").fillna(0.0, ["ax", "ay"]).withColumns({"fx": F.col("fx") + F.col("ax"), "fy": F.col("fy") + F.col("ay")})
        size = F.sqrt(F.col("fx") * F.col("fx") + F.col("fy") * F.col("fy"))
        step = F.least(F.lit(1.0), (0.5 * (1 - k / steps) + 0.01) / F.greatest(size, F.lit(1e-9)))
        now = cut(moved.select("node", (F.col("x") + F.col("fx") * step).alias("x"), (F.col("y") + F.col("fy") * step).alias("y"), "mass"), "layout")
    return minmax(now.select("node", "x", "y"))


def pull_leaves(layout: DataFrame, degrees: DataFrame) -> DataFrame:
    """Coordinates of nodes of degree 1 or less are halved."""
    d = layout.join(degrees.select("node", "degree"), "node", "left")
    half = F.when(F.coalesce("degree", F.lit(0)) <= 1, 0.5).otherwise(1.0)
    return d.select("node", (F.col("x") * half).alias("x"), (F.col("y") * half).alias("y"))


def layer_offsets(layout: DataFrame, layers: DataFrame, gap: float = 1.5) -> DataFrame:
    """Layers drawn beside each other in order of name: x moved by gap for each layer before. layout: (node, layer, x, y)."""
    order = layers.select("layer").distinct().withColumn("k", F.row_number().over(Window.orderBy("layer")) - 1)
    return layout.join(F.broadcast(order), "layer").select("node", "layer", (F.col("x") + gap * F.col("k")).alias("x"), (F.col("y") + gap * F.col("k")).alias("y"))


def node_sizes(degrees: DataFrame, size: float = 1.0, log_above: int | None = None) -> DataFrame:
    """degree * size, or its logarithm for degrees above log_above."""
    d = F.col("degree") * F.lit(size)
    return degrees.withColumn("size", d if log_above is None else F.when(F.col("degree") > log_above, F.ln(d)).otherwise(d))


def rgb(hex_: Column) -> Column:
    part = lambda k: F.conv(F.substring(hex_, k, 2), 16, 10).cast("int")
    return F.array(part(2), part(4), part(6))


def hex_colour(r: Column, g: Column, b: Column) -> Column:
    return F.concat(F.lit("#"), *[F.lower(F.lpad(F.hex(c.cast("long")), 2, "0")) for c in (r, g, b)])


def gradient(spark, start: str, end: str, n: int) -> DataFrame:
    """(k, colour): n colours in even steps from start to end."""
    a, b = rgb(F.lit(start)), rgb(F.lit(end))
    t = F.col("id") / max(1, n - 1)
    at = [F.floor(a[k] + t * (b[k] - a[k])) for k in range(3)]
    return spark.range(n).select(F.col("id").alias("k"), hex_colour(*at).alias("colour"))


def _points(n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: i / float(n - 1))


def bezier(df: DataFrame, n: int = 20, height: float = 1.0) -> DataFrame:
    """Adds curve array<struct<x, y>> between (x1, y1) and (x2, y2): a quadratic curve over the middle, lifted by height."""
    mx, my = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2 + height
    at = lambda t, a, m, b: (1 - t) * (1 - t) * a + 2 * t * (1 - t) * m + t * t * b
    return df.withColumn("curve", F.transform(_points(n), lambda t: F.struct(at(t, F.col("x1"), mx, F.col("x2")).alias("x"), at(t, F.col("y1"), my, F.col("y2")).alias("y"))))


def cubic(df: DataFrame, n: int = 20) -> DataFrame:
    """A cubic that leaves and arrives level."""
    s = lambda t: t * t * (3 - 2 * t)
    return df.withColumn("curve", F.transform(_points(n), lambda t: F.struct((F.col("x1") + t * (F.col("x2") - F.col("x1"))).alias("x"), (F.col("y1") + s(t) * (F.col("y2") - F.col("y1"))).alias("y"))))


def pyramid(df: DataFrame, height: float = 1.0) -> DataFrame:
    """Two straight lines over a lifted middle."""
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return df.withColumn("curve", F.array(p(F.col("x1"), F.col("y1")), p((F.col("x1") + F.col("x2")) / 2, F.greatest("y1", "y2") + height), p(F.col("x2"), F.col("y2"))))
