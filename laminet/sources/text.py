"""Loaders of network text formats: each returns a MultilayerNetwork (or a table), from any path that Spark can read."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from laminet.model import MultilayerNetwork, NetConfig, edge_table


def rows_of(spark: SparkSession, path: str, comment: str | None = "#") -> DataFrame:
    """(line, t): non-empty lines split at white space (CR and LF alike), in order of the monotonic line number."""
    df = spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), F.trim(F.regexp_replace("value", r"[\r\t]", " ")).alias("v")).where("v <> ''")
    if comment:
        df = df.where(~F.col("v").startswith(comment))
    return df.select("line", F.split("v", r"\s+").alias("t"))


def _t(i: int) -> Column:
    return F.get("t", F.lit(i))


def _weight(i: int) -> Column:
    return F.coalesce(_t(i).try_cast("double"), F.lit(1.0))


def multiedgelist(spark, path, config: NetConfig | None = None) -> MultilayerNetwork:
    """n1 l1 n2 l2 [w]"""
    e = rows_of(spark, path).where(F.size("t") >= 4).select(_t(0).alias("src"), _t(1).alias("src_layer"), _t(2).alias("dst"), _t(3).alias("dst_layer"), _weight(4).alias("weight"))
    return MultilayerNetwork.from_edges(e, config=config)


def edgelist(spark, path, config: NetConfig | None = None) -> MultilayerNetwork:
    """n1 n2 [w], gzip too; of duplicates the last counts, which a turned round line is too unless the network is directed."""
    e = rows_of(spark, path).where(F.size("t") >= 2).select("line", _t(0).alias("src"), _t(1).alias("dst"), _weight(2).alias("weight"))
    ends = ["src", "dst"] if config and config.directed else [F.least("src", "dst").alias("_a"), F.greatest("src", "dst").alias("_b")]
    e = e.groupBy(*ends).agg(F.max_by(F.struct("src", "dst", "weight"), "line").alias("last")).select("last.*")
    return MultilayerNetwork.from_edges(e, config=config)


def edgelist_with_types(spark, path, config: NetConfig | None = None) -> MultilayerNetwork:
    """n1 n2 w type"""
    return MultilayerNetwork.from_edges(rows_of(spark, path).select(_t(0).alias("src"), _t(1).alias("dst"), _weight(2).alias("weight"), _t(3).alias("etype")), config=config)


def edgelist_spin(spark, path, config: NetConfig | None = None) -> MultilayerNetwork:
    """n1 n2 tag [w]"""
    return MultilayerNetwork.from_edges(rows_of(spark, path).select(_t(0).alias("src"), _t(1).alias("dst"), _t(2).alias("etype"), _weight(3).alias("weight")), config=config)


def multiplex_edges(spark, path, config: NetConfig | None = None) -> MultilayerNetwork:
    """layer n1 n2 w"""
    e = rows_of(spark, path).where(F.size("t") >= 3).select(_t(1).alias("src"), _t(0).alias("src_layer"), _t(2).alias("dst"), _t(0).alias("dst_layer"), _weight(3).alias("weight"))
    return MultilayerNetwork.from_edges(e, config=config or NetConfig(network_type="multiplex"))


def layer_names(spark, path, header: str = "layerID") -> DataFrame:
    """(layer, name)"""
    return rows_of(spark, path).where(_t(0) != header).select(_t(0).alias("layer"), F.array_join(F.slice("t", 2, F.size("t")), " ").alias("name"))


def activity(spark, path, names: DataFrame | None = None) -> DataFrame:
    """n1 n2 epoch_seconds layer_label: (node_first, node_second, layer, timestamp); names (layer, name) turn labels into ids."""
    a = rows_of(spark, path).where(F.size("t") >= 4).select(_t(0).alias("node_first"), _t(1).alias("node_second"), _t(3).alias("label"), F.timestamp_seconds(_t(2).cast("long")).alias("timestamp"))
    if names is None:
        return a.withColumnRenamed("label", "layer")
    return a.join(names.withColumnRenamed("name", "label"), "label").select("node_first", "node_second", "layer", "timestamp")


def multiplex_folder(spark, path, config: NetConfig | None = None) -> tuple[MultilayerNetwork, DataFrame | None, DataFrame | None]:
    """The network of *.edges, names of *layers.txt and activity of *activity.txt (None where absent)."""

    def optional(glob: str, load):
        files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{glob}")
        return load() if files.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(files) else None

    names = optional("*layers.txt", lambda: layer_names(spark, f"{path}/*layers.txt"))
    return multiplex_edges(spark, f"{path}/*.edges", config), names, optional("*activity.txt", lambda: activity(spark, f"{path}/*activity.txt", names))


def embedding(spark, path) -> DataFrame:
    """word2vec text, its header of two tokens skipped: (node, embedding array<float>)"""
    return rows_of(spark, path, None).where(F.size("t") > 2).select(_t(0).alias("node"), F.transform(F.slice("t", 2, F.size("t")), lambda x: x.cast("float")).alias("embedding"))


def communities(spark, path, nodes: DataFrame | None = None) -> DataFrame:
    """node community; with nodes (node, layer) each of these, null where it has none."""
    c = rows_of(spark, path).select(_t(0).alias("node"), _t(1).alias("community"))
    return c if nodes is None else nodes.select("node", "layer").join(c, "node", "left")


def gaf(spark, path, distinct: bool = True) -> DataFrame:
    """(entity, term) of annotation files: tab separated, columns 2 and 5, comments start with !"""
    a = spark.read.text(path).where(~F.col("value").startswith("!")).select(F.split("value", "\t").alias("t")).where(F.size("t") > 4).select(_t(1).alias("entity"), _t(4).alias("term"))
    return a.distinct() if distinct else a


def top_terms(annotations: DataFrame, n: int, marker: str = "GO:") -> DataFrame:
    """Annotations by the n most frequent terms that hold the marker; ties by term."""
    a = annotations.where(F.col("term").contains(marker))
    return a.join(F.broadcast(a.groupBy("term").count().orderBy(F.desc("count"), "term").limit(n).select("term")), "term", "left_semi")


def mapping(spark, path) -> DataFrame:
    """node module"""
    return rows_of(spark, path).select(_t(0).alias("node"), _t(1).alias("community"))


def terms(spark, path) -> DataFrame:
    return rows_of(spark, path, None).select(_t(0).alias("term"))


def hierarchy(spark, path) -> DataFrame:
    """class<tab>sup1;sup2: (child, parent)"""
    return spark.read.text(path).select(F.split("value", "\t").alias("t")).where(F.size("t") > 1).select(F.trim(_t(0)).alias("child"), F.explode(F.split(F.trim(_t(1)), ";")).alias("parent")).where("parent <> ''")


def examples(spark, path) -> tuple[DataFrame, DataFrame]:
    """ex;a1;...;label with a header, attributes 0/1 or names: examples (ex, label) and membership (pred, ex)."""
    raw = spark.read.option("header", True).option("sep", ";").csv(path)
    key, label, attrs = raw.columns[0], raw.columns[-1], raw.columns[1:-1]
    ex = raw.select(F.trim(key).alias("ex"), F.trim(label).alias("label"))
    cells = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.trim(a).alias("v")) for a in attrs])).alias("c")
    m = raw.select(F.trim(key).alias("ex"), cells).where("c.v is not null and c.v not in ('', '0')")
    return ex, m.select(F.when(F.col("c.v") == "1", F.col("c.a")).otherwise(F.col("c.v")).alias("pred"), "ex")


def ntriples(spark, path) -> DataFrame:
    """(s, p, o) of n-triples: one statement a line; prefixes aren't expanded."""
    m = r"^\s*(\S+)\s+(\S+)\s+(.+?)\s*\.\s*$"
    strip = lambda c: F.regexp_replace(c, r"^<|>$", "")
    return spark.read.text(path).where(F.col("value").rlike(m) & ~F.ltrim("value").startswith("@") & ~F.ltrim("value").startswith("#")).select(*[strip(F.regexp_extract("value", m, i)).alias(n) for i, n in ((1, "s"), (2, "p"), (3, "o"))])


def obo(spark, path) -> DataFrame:
    """(child, parent) of id: and is_a: lines of one ontology file. Stanzas are short, so the file is read by stanza."""
    stanza = spark.read.option("lineSep", "\n[").text(path)
    idd = F.regexp_extract("value", r"(?m)^id:\s*(\S+)", 1)
    return stanza.select(idd.alias("child"), F.explode(F.regexp_extract_all("value", F.lit(r"(?m)^is_a:\s*(\S+)"), F.lit(1))).alias("parent")).where("child <> ''")


def detangler_json(spark, path, config: NetConfig | None = None) -> MultilayerNetwork:
    """{nodes: [{id, label, descriptors 'l1;l2'}], links: [{source, target, descriptors}]}: a node for each layer, its layers linked, and
    a link for each layer of a link."""
    raw = spark.read.option("wholetext", True).text(path)
    kind = "nodes array<struct<id:string,label:string,descriptors:string>>, links array<struct<source:string,target:string,descriptors:string>>"
    j = raw.select(F.from_json("value", kind).alias("j"))
    n = j.select(F.explode("j.nodes").alias("n")).select("n.id", F.coalesce("n.label", "n.id").alias("node"), F.explode(F.split("n.descriptors", ";")).alias("layer"))
    pairs = n.alias("a").join(n.alias("b"), F.col("a.id") == F.col("b.id")).where("a.layer < b.layer").select(F.col("a.node").alias("src"), F.col("a.layer").alias("src_layer"), F.col("b.node").alias("dst"), F.col("b.layer").alias("dst_layer"), F.lit("coupling").alias("etype"))
    names = n.select("id", "node").distinct()
    links = j.select(F.explode("j.links").alias("l")).select("l.source", "l.target", F.explode(F.split("l.descriptors", ";")).alias("layer"))
    links = links.join(names.toDF("source", "src"), "source").join(names.toDF("target", "dst"), "target").select("src", F.col("layer").alias("src_layer"), "dst", F.col("layer").alias("dst_layer"), F.lit("default").alias("etype"))
    return MultilayerNetwork.from_edges(pairs.unionByName(links), n.select("node", "layer"), config)


def _gml_items(text: str) -> list[tuple[str, dict]]:
    import re

    tokens = re.findall(r'"[^"]*"|[^\s\[\]]+|\[|\]', text)
    out, i, depth, kind, now = [], 0, 0, None, {}
    while i < len(tokens):
        t = tokens[i]
        if t == "]":
            depth -= 1
            if depth == 1 and kind:
                out.append((kind, now))
                kind = None
            i += 1
        elif i + 1 < len(tokens) and tokens[i + 1] == "[":
            depth += 1
            if depth == 2 and t in ("node", "edge"):
                kind, now = t, {}
            i += 2
        else:
            if kind and depth == 2 and i + 1 < len(tokens):
                now[t] = tokens[i + 1].strip('"')
            i += 2
    return out


def gml(spark, path, config: NetConfig | None = None, delimiter: str = "---") -> MultilayerNetwork:
    """GML files, one a task: nodes (label, type) with their labels, edges with their types."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in batches:
            rows = [(f, k, a) for f, v in zip(g["file"], g["value"]) for k, a in _gml_items(v)]
            yield pd.DataFrame([(f, k, a) for f, k, a in rows], columns=["file", "kind", "a"])

    raw = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("file"), "value")
    items = raw.mapInPandas(parse, "file string, kind string, a map<string,string>")
    a = lambda k: F.col("a")[k]
    n = items.where("kind = 'node'").select("file", a("id").alias("id"), F.coalesce(a("label"), a("id")).alias("node"), F.coalesce(a("type"), F.lit("null")).alias("layer"), F.split(a("labels"), delimiter).alias("labels"))
    e = items.where("kind = 'edge'").select("file", a("source").alias("s"), a("target").alias("t"), F.coalesce(a("type"), a("key"), F.lit("default")).alias("etype"), F.coalesce(a("weight").try_cast("double"), F.lit(1.0)).alias("weight"))
    ids = n.select("file", "id", "node", "layer")
    e = e.join(ids.toDF("file", "s", "src", "src_layer"), ["file", "s"]).join(ids.toDF("file", "t", "dst", "dst_layer"), ["file", "t"]).select("src", "src_layer", "dst", "dst_layer", "etype", "weight")
    return MultilayerNetwork.from_edges(e, n.select("node", "layer", F.col("layer").alias("ntype"), "labels"), config)


def sections(spark, path) -> DataFrame:
    """Files with lines *Heading before their data (Pajek, multilayer link lists): (section, t) of one file in order."""
    df = spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), F.trim("value").alias("v")).where("v <> '' and not startswith(v, '#') and not startswith(v, '%')")
    head = F.when(F.col("v").startswith("*"), F.lower(F.regexp_extract("v", r"^\*(\w+)", 1)))
    w = Window.orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("section", F.coalesce(F.last(head, True).over(w), F.lit("links"))).where(~F.col("v").startswith("*")).select("section", F.split("v", r"\s+").alias("t"))


def pajek(spark, path, config: NetConfig | None = None) -> MultilayerNetwork:
    s = sections(spark, path)
    v = s.where("section = 'vertices'").select(_t(0).alias("id"), F.regexp_replace(_t(1), '"', "").alias("name"))
    e = s.where("section in ('edges', 'arcs', 'links')").select(_t(0).alias("a"), _t(1).alias("b"), _weight(2).alias("weight"))
    e = e.join(v.toDF("a", "sn"), "a", "left").join(v.toDF("b", "dn"), "b", "left")
    return MultilayerNetwork.from_edges(e.select(F.coalesce("sn", "a").alias("src"), F.coalesce("dn", "b").alias("dst"), "weight"), config=config)


def multilayer_links(spark, path, config: NetConfig | None = None) -> MultilayerNetwork:
    """*Multilayer (l1 n1 l2 n2 [w]), *Intra (l n1 n2 [w]) and *Inter (l1 n l2 [w]) sections."""
    s = sections(spark, path)
    cols = lambda *i: [c.alias(n) for c, n in zip(i, ("src_layer", "src", "dst_layer", "dst", "weight"))]
    m = s.where("section in ('multilayer', 'multiplex')").select(*cols(_t(0), _t(1), _t(2), _t(3), _weight(4)))
    a = s.where("section = 'intra'").select(*cols(_t(0), _t(1), _t(0), _t(2), _weight(3)))
    b = s.where("section = 'inter'").select(*cols(_t(0), _t(1), _t(2), _t(1), _weight(3)))
    return MultilayerNetwork.from_edges(m.union(a).union(b), config=config)


def link_list(spark, path, config: NetConfig | None = None) -> MultilayerNetwork:
    return MultilayerNetwork.from_edges(rows_of(spark, path).select(_t(0).alias("src"), _t(1).alias("dst"), _weight(2).alias("weight")), config=config)


def coo(spark, path, labels: str | None = None) -> tuple[MultilayerNetwork, DataFrame | None]:
    """A sparse matrix as Parquet (i, j, v), all nodes in layer generic, and labels (i, label)."""
    e = spark.read.parquet(path).select(F.col("i").alias("src"), F.lit("generic").alias("src_layer"), F.col("j").alias("dst"), F.lit("generic").alias("dst_layer"), F.col("v").alias("weight"))
    return MultilayerNetwork.from_edges(e), spark.read.parquet(labels) if labels else None


def native(spark, path) -> MultilayerNetwork:
    """What save_native() wrote."""
    config = NetConfig(**json.loads(spark.read.parquet(f"{path}/config").first()["config"]))
    return MultilayerNetwork(spark.read.parquet(f"{path}/edges").drop("layer_part"), spark.read.parquet(f"{path}/nodes"), config)


def split_ids(df: DataFrame, separator: str = "_") -> DataFrame:
    """Edges whose ids are layer<separator>node: (src, src_layer, dst, dst_layer, etype, weight)."""
    part = lambda c, i: F.split(F.col(c), separator, 2)[i]
    etype = F.col("key").cast("string") if "key" in df.columns else F.lit("default")
    weight = F.col("weight") if "weight" in df.columns else F.lit(1.0)
    return edge_table(df.select(part("src", 1).alias("src"), part("src", 0).alias("src_layer"), part("dst", 1).alias("dst"), part("dst", 0).alias("dst_layer"), etype.alias("etype"), weight.alias("weight")))


def edge_tuples(spark, rows: list[tuple], config: NetConfig | None = None) -> MultilayerNetwork:
    """(n1, n2, l1, l2, w) rows."""
    rows = [(str(a), str(la), str(b), str(lb), float(w)) for a, b, la, lb, w in rows]
    return MultilayerNetwork.from_edges(spark.createDataFrame(rows, "src string, src_layer string, dst string, dst_layer string, weight double"), config=config)


LOADERS = {
    "multiedgelist": multiedgelist, "edgelist": edgelist, "edgelist_with_edge_types": edgelist_with_types, "edgelist_spin": edgelist_spin, "multiplex_edges": multiplex_edges,
    "multiplex_folder": lambda spark, path, config=None: multiplex_folder(spark, path, config)[0], "gml": gml, "detangler_json": detangler_json, "pajek": pajek, "link_list": link_list,
    "multilayer_links": multilayer_links, "sparse": lambda spark, path, config=None: coo(spark, path)[0], "native": lambda spark, path, config=None: native(spark, path),
}


def load_network(spark: SparkSession, path: str, input_type: str, config: NetConfig | None = None) -> MultilayerNetwork:
    if input_type not in LOADERS:
        raise ValueError(f"no input type {input_type!r}; there are {', '.join(sorted(LOADERS))}")
    return LOADERS[input_type](spark, path, config)
