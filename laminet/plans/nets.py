"""The networks that the registered queries run on, as DataFrames and as SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laminet.model import MultilayerNetwork
from laminet.session import cut, wide


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers by layers of order priority, an edge for each line item, its quantity the weight."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    layer = F.col("o_orderpriority")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"), layer.alias("src_layer"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst"), layer.alias("dst_layer"), F.lit("default").alias("etype"), F.col("l_quantity").cast("double").alias("weight")
    )


def trade(spark: SparkSession, sf_dir: str) -> MultilayerNetwork:
    return MultilayerNetwork.from_edges(trade_edges(spark, sf_dir))


TRADE = """trade AS (SELECT 'c' || o_custkey AS src, o_orderpriority AS src_layer, 's' || l_suppkey AS dst, o_orderpriority AS dst_layer, 'default' AS etype, l_quantity::DOUBLE AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
nodes AS (SELECT src AS node, src_layer AS layer FROM trade UNION SELECT dst, dst_layer FROM trade)"""


def cross_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As trade, but suppliers are in layers of return flags, so that all edges run between layers; typed by line status."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"), F.col("o_orderpriority").alias("src_layer"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst"), F.col("l_returnflag").alias("dst_layer"), F.col("l_linestatus").alias("etype"), F.col("l_quantity").cast("double").alias("weight")
    )


def brand_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands and nations of customers, the number of line items as weight: a small directed graph."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("nation"))
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
    return j.groupBy(F.col("p_brand").alias("src"), F.col("nation").alias("dst")).agg(F.count("*").cast("double").alias("weight"))


BRAND_NATION = """bn AS (SELECT p_brand AS src, 'n' || c_nationkey AS dst, count(*)::DOUBLE AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""


def supplier_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of suppliers and of customers that trade: undirected pairs a <= b with the number of line items."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    a, b = F.concat(F.lit("n"), F.col("c_nationkey").cast("string")), F.concat(F.lit("n"), F.col("s_nationkey").cast("string"))
    return j.select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")).groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


SUPPLIER_GRAPH = """sg AS (SELECT least('n' || c_nationkey, 'n' || s_nationkey) AS src, greatest('n' || c_nationkey, 'n' || s_nationkey) AS dst, count(*)::DOUBLE AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"""


def geo_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hierarchy customer and supplier - nation - region: (child, parent)."""
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    c = table(spark, sf_dir, "customer").select(key("c", "c_custkey").alias("child"), key("n", "c_nationkey").alias("parent"))
    s = table(spark, sf_dir, "supplier").select(key("s", "s_suppkey").alias("child"), key("n", "s_nationkey").alias("parent"))
    n = table(spark, sf_dir, "nation").select(key("n", "n_nationkey").alias("child"), key("r", "n_regionkey").alias("parent"))
    return c.union(s).union(n)


GEO = """geo AS (SELECT 'c' || c_custkey AS child, 'n' || c_nationkey AS parent FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)"""


def nation_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers by nation: (node, community)."""
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node"), F.col("c_nationkey").cast("long").alias("community"))
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")), F.col("s_nationkey").cast("long"))
    return c.union(s)


PARTITION = """part_of AS (SELECT 'c' || c_custkey AS node, c_nationkey::BIGINT AS community FROM customer UNION ALL SELECT 's' || s_suppkey, s_nationkey::BIGINT FROM supplier)"""


def flat_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trade_edges(spark, sf_dir).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


FLAT = "flat AS (SELECT src, dst, sum(weight) AS weight FROM trade GROUP BY 1, 2)"


def hin(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Customers (labelled by market segment) that purchased brands, which are purchased by them: nodes, edges, labels. The purchases are
    written, for all three come from them."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    # Sets of brand and size are small enough to make pairs of customers.
    mid = F.concat_ws("/", F.col("p_brand"), F.col("p_size").cast("string"))
    e = wide(wide(li, "l_orderkey").join(o, F.col("l_orderkey") == F.col("o_orderkey")), "l_partkey").join(p, F.col("l_partkey") == F.col("p_partkey"))
    e = cut(wide(e.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("c"), mid.alias("m")), "c").distinct(), "purchases")
    edges = e.select(F.col("c").alias("src"), F.col("m").alias("dst"), F.lit("purchased").alias("etype")).union(e.select("m", "c", F.lit("purchased_by")))
    labels = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node"), F.col("c_mktsegment").alias("label"))
    nodes = labels.select("node", F.lit("customer").alias("ntype"), F.array("label").alias("labels")).union(e.select("m", F.lit("brand"), F.array().cast("array<string>")).distinct())
    return nodes, edges, labels


HIN = """pts0 AS (SELECT DISTINCT p_brand || '/' || p_size AS mid, 'c' || o_custkey AS point FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
pts AS (SELECT mid, point FROM pts0 WHERE mid IN (SELECT mid FROM pts0 GROUP BY 1 HAVING count(*) > 1)),
lab AS (SELECT 'c' || c_custkey AS node, c_mktsegment AS label FROM customer)"""


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("user_id").cast("string").alias("node_first"), F.get_json_object("props", "$.k").alias("node_second"), F.col("event_type").alias("layer"), "ts", "value")


def annotations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents as members of their sources, and the words that they hold as terms."""
    d = table(spark, sf_dir, "documents")
    members = d.select(F.col("doc_id").alias("entity"), F.col("source").alias("partition"))
    words = F.filter(F.array_distinct(F.split(F.lower("text"), "[^a-z]+")), lambda w: F.length(w) > 0)
    return members, d.select(F.col("doc_id").alias("entity"), words.alias("terms"))


ANNOT = """mem AS (SELECT doc_id AS entity, source AS "partition" FROM documents),
ann AS (SELECT DISTINCT doc_id AS entity, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS term FROM documents),
a AS (SELECT mem.entity, "partition", term FROM mem JOIN ann ON mem.entity = ann.entity WHERE length(term) > 0),
cnt AS (SELECT x."partition", x.term, x.inside, y.n - x.inside AS outside, s.size, (SELECT count(*) FROM mem) AS total FROM (SELECT "partition", term, count(*) AS inside FROM a GROUP BY 1, 2) x JOIN (SELECT term, count(*) AS n FROM a GROUP BY 1) y ON x.term = y.term JOIN (SELECT "partition", count(*) AS size FROM mem GROUP BY 1) s ON s."partition" = x."partition")"""


def supplier_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items of each customer: (node, degree)."""
    return trade_edges(spark, sf_dir).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))


DEGREES = "deg AS (SELECT src AS node, count(*) AS degree FROM trade GROUP BY 1)"


def predicates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers as examples of their segments; nation, region and balance as predicates."""
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation")
    ex = c.select(F.col("c_custkey").alias("ex"), F.col("c_mktsegment").alias("label"))
    j = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    preds = F.array(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")), F.concat(F.lit("b"), F.floor(F.col("c_acctbal") / 1000).cast("string")))
    return ex, j.select(F.explode(preds).alias("pred"), F.col("c_custkey").alias("ex"))


PREDICATES = """ex AS (SELECT c_custkey AS ex, c_mktsegment AS label FROM customer),
mem AS (SELECT 'n' || c_nationkey AS pred, c_custkey AS ex FROM customer UNION ALL SELECT 'r' || n_regionkey, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 'b' || floor(c_acctbal / 1000)::BIGINT, c_custkey FROM customer)"""
