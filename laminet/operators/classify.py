"""Node classification: top-k labels, F1, validation of label propagation and of PageRank vectors, walk embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from laminet.operators.iterate import all_ppr, biased_walks, label_propagation, names_of


def top_k_labels(scores: DataFrame, truth: DataFrame) -> DataFrame:
    """(node, label): as many best labels of each node as it truly has. scores: (node, label, v); truth: (node, label)."""
    k = truth.groupBy("node").agg(F.countDistinct("label").alias("k"))
    w = Window.partitionBy("node").orderBy(F.desc("v"), "label")
    return scores.withColumn("_r", F.row_number().over(w)).join(k, "node").where(F.col("_r") <= F.col("k")).select("node", "label")


def f1(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """One row (micro, macro) of sets of (node, label)."""
    p, t = predicted.select("node", "label").distinct().withColumn("_p", F.lit(1)), truth.select("node", "label").distinct().withColumn("_t", F.lit(1))
    both = p.join(t, ["node", "label"], "full").fillna(0, ["_p", "_t"])
    c = both.groupBy("label").agg(F.sum(F.col("_p") * F.col("_t")).alias("tp"), F.sum(F.col("_p") * (1 - F.col("_t"))).alias("fp"), F.sum((1 - F.col("_p")) * F.col("_t")).alias("fn"))
    one = lambda tp, fp, fn: F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0)
    return c.agg(one(F.sum("tp"), F.sum("fp"), F.sum("fn")).alias("micro"), F.avg(one(F.col("tp"), F.col("fp"), F.col("fn"))).alias("macro"))


def _test_side(node: str, share: float, seed: int):
    return (F.xxhash64(node, F.lit(seed)) / F.lit(2.0**64) + 0.5) >= share


def validate_label_propagation(edges: DataFrame, labels: DataFrame, shares: tuple[float, ...] = tuple(i / 10 for i in range(1, 10)), repeats: int = 1, alpha: float = 0.001, steps: int = 10, scheme: str = "basic", seed: int = 123) -> DataFrame:
    """(share, repeat, micro, macro): labels of a random share are spread, the others' predicted."""
    spark, out = edges.sparkSession, []
    for share in shares:
        for r in range(repeats):
            test = _test_side("node", share, seed + r)
            got = label_propagation(edges, labels.where(~test).withColumn("v", F.lit(1.0)), alpha, steps, None, scheme)
            truth = labels.where(test)
            row = f1(top_k_labels(got.join(truth.select("node").distinct(), "node", "left_semi"), truth), truth).first()
            out.append((share, r, row["micro"], row["macro"]))
    return spark.createDataFrame(out, "share double, repeat int, micro double, macro double")


def vectors(sparse: DataFrame, index: DataFrame) -> DataFrame:
    """(node, features vector) from (seed, node, rank) and an index (node, i)."""
    from pyspark.ml.functions import array_to_vector

    n = index.count()
    per = sparse.join(index, "node").groupBy(F.col("seed").alias("node")).agg(F.map_from_entries(F.collect_list(F.struct("i", "rank"))).alias("m"))
    return per.select("node", array_to_vector(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0.0)))).alias("features"))


def evaluate(features: DataFrame, labels: DataFrame, classifier=None, shares: tuple[float, ...] = (0.5,), repeats: int = 1, seed: int = 123) -> DataFrame:
    """(share, repeat, micro, macro) of a one-vs-rest classifier (linear SVC unless another estimator is given); labels of two members or fewer go."""
    from pyspark.ml.classification import LinearSVC, OneVsRest
    from pyspark.ml.feature import StringIndexer

    big = labels.groupBy("label").agg(F.count("*").alias("n")).where("n > 2").select("label")
    one = labels.join(big, "label").groupBy("node").agg(F.min("label").alias("label"))
    coder = StringIndexer(inputCol="label", outputCol="y").fit(one)
    data = coder.transform(features.join(one, "node")).persist()
    spark, out = features.sparkSession, []
    for share in shares:
        for r in range(repeats):
            test = _test_side("node", share, seed + r)
            model = OneVsRest(classifier=classifier or LinearSVC(maxIter=20), labelCol="y", featuresCol="features").fit(data.where(~test))
            got = model.transform(data.where(test))
            row = f1(got.select("node", F.col("prediction").alias("label")), got.select("node", F.col("y").alias("label"))).first()
            out.append((share, r, row["micro"], row["macro"]))
    data.unpersist()
    return spark.createDataFrame(out, "share double, repeat int, micro double, macro double")


def validate_ppr(edges: DataFrame, labels: DataFrame, classifier=None, **options) -> DataFrame:
    index = names_of(edges).withColumn("i", F.row_number().over(Window.orderBy("node")) - 1)
    ppr = all_ppr(edges, labels.select("node").distinct(), steps=10)
    return evaluate(vectors(ppr, index), labels, classifier, **options)


def node2vec(edges: DataFrame, dim: int = 32, walks: int = 5, steps: int = 10, p: float = 1.0, q: float = 1.0, seed: int = 1) -> DataFrame:
    """(node, features): word vectors of biased walks."""
    from pyspark.ml.feature import Word2Vec

    starts = names_of(edges).select("node", F.explode(F.sequence(F.lit(0), F.lit(walks - 1))).alias("r"))
    starts = starts.select(F.xxhash64("node", "r").alias("walker"), "node")
    path = biased_walks(edges, starts, steps, p, q, seed)
    text = path.groupBy("walker").agg(F.transform(F.sort_array(F.collect_list(F.struct("step", "node"))), lambda x: x["node"]).alias("text"))
    model = Word2Vec(vectorSize=dim, minCount=0, inputCol="text", outputCol="v", seed=seed).fit(text)
    return model.getVectors().select(F.col("word").alias("node"), F.col("vector").alias("features"))


def node2vec_grid(edges: DataFrame, labels: DataFrame, grid: tuple[float, ...] = (0.25, 0.5, 1, 2, 4), **options) -> tuple[float, float, float]:
    """(p, q, macro F1) of the best pair."""
    best = max(((p, q, evaluate(node2vec(edges, p=p, q=q, **options), labels).first()["macro"]) for p in grid for q in grid), key=lambda x: x[2])
    return best


def coordinates(features: DataFrame) -> DataFrame:
    """(node, x, y): the two main principal components."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import vector_to_array

    got = PCA(k=2, inputCol="features", outputCol="c").fit(features).transform(features).select("node", vector_to_array("c").alias("c"))
    return got.select("node", F.col("c")[0].alias("x"), F.col("c")[1].alias("y"))
