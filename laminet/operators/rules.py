"""Descriptive rules: knowledge base closure, coverage, scores, learners and their validation.

examples: (ex, label or score); membership: (pred, ex); subclass_of: (child, parent). A rule is a conjunction of unary predicates, or
of such about what a binary relation (pred, ex, other) leads to.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from laminet.functions.special import fisher_exact
from laminet.session import cut


@dataclass(frozen=True)
class Defaults:
    """Settings of the learners."""

    score: str = "lift"
    adjust: str = "fwer"
    beam: int = 20
    support: float = 0.1
    depth: int = 5
    alpha: float = 0.05
    q: float = 0.01


def closure(subclass_of: DataFrame) -> DataFrame:
    """(child, ancestor), each class with itself too. A cycle raises."""
    e = cut(subclass_of.select("child", "parent").distinct(), "subclasses")
    front = e.select("child", F.col("parent").alias("ancestor"))
    seen = front
    while True:
        if not front.where("child = ancestor").isEmpty():
            raise ValueError("the class hierarchy has a cycle")
        front = cut(front.join(e.toDF("ancestor", "up"), "ancestor").select("child", F.col("up").alias("ancestor")).distinct().join(seen, ["child", "ancestor"], "left_anti"), "closure")
        if front.isEmpty():
            break
        seen = seen.union(front)
    own = e.select(F.explode(F.array("child", "parent")).alias("child")).distinct().select("child", F.col("child").alias("ancestor"))
    return seen.union(own).distinct()


def roots(subclass_of: DataFrame) -> DataFrame:
    return subclass_of.select(F.col("parent").alias("pred")).distinct().join(subclass_of.select(F.col("child").alias("pred")), "pred", "left_anti")


def levels(subclass_of: DataFrame) -> DataFrame:
    """(pred, level): longest way from a root."""
    e = cut(subclass_of.select("child", "parent").distinct(), "subclasses")
    most = e.select(F.explode(F.array("child", "parent")).alias("pred")).distinct().count()
    now = roots(e).withColumn("level", F.lit(0))
    out = now
    for level in range(1, most + 1):
        now = cut(now.join(e, now["pred"] == e["parent"]).select(F.col("child").alias("pred")).distinct().withColumn("level", F.lit(level)), "levels")
        if now.isEmpty():
            return out.groupBy("pred").agg(F.max("level").alias("level"))
        out = out.union(now)
    raise ValueError("the class hierarchy has a cycle")


def member_closure(membership: DataFrame, subclass_of: DataFrame) -> DataFrame:
    """(pred, ex) with every class holding what its subclasses hold."""
    up = closure(subclass_of)
    lifted = membership.join(up, membership["pred"] == up["child"]).select(F.col("ancestor").alias("pred"), "ex")
    return lifted.union(membership.select("pred", "ex")).distinct()


def through(relation: DataFrame, membership: DataFrame) -> DataFrame:
    """Existential predicates `relation.pred` of an example that is related to a member of pred."""
    m = membership.select(F.col("pred").alias("p"), F.col("ex").alias("other"))
    return relation.join(m, "other").select(F.concat_ws(".", "pred", "p").alias("pred"), "ex").distinct()


def negated(membership: DataFrame, examples: DataFrame) -> DataFrame:
    """`not pred` for the examples that lack pred. Predicates are those of the knowledge base, which is smaller than the data."""
    preds = membership.select("pred").distinct().withColumn("_j", F.lit(0))
    grid = examples.select("ex").distinct().withColumn("_j", F.lit(0)).join(preds, "_j").select("pred", "ex")
    return grid.join(membership.select("pred", "ex"), ["pred", "ex"], "left_anti").select(F.concat(F.lit("not "), "pred").alias("pred"), "ex")


# Scores from counts: tp of the rule in the target class, n covered, p of the target, N all

SCORES = {
    "precision": lambda tp, n, p, N: tp / n,
    "lift": lambda tp, n, p, N: (tp / n) / (p / N),
    "leverage": lambda tp, n, p, N: tp / N - (n / N) * (p / N),
    "wracc": lambda tp, n, p, N: (n / N) * (tp / n - p / N),
    "chisq": lambda tp, n, p, N: N * (tp * (N - n - p + tp) - (n - tp) * (p - tp)) * (tp * (N - n - p + tp) - (n - tp) * (p - tp)) / (n * p * (N - n) * (N - p)),
}
#: Bounds (above, up to) within which a rule's score is of interest.
BOUNDS = {"precision": (0.5, 1.0), "lift": (1.0, float("inf")), "leverage": (0.0, 1.0), "wracc": (0.0, 1.0), "chisq": (3.841, float("inf"))}


def rule_counts(covered: DataFrame, examples: DataFrame, rule: str = "rule") -> DataFrame:
    """(rule, target, tp, n, p, total) from covered (rule, ex) and examples (ex, label)."""
    ex = examples.select("ex", F.col("label").alias("target"))
    size = ex.agg(F.count("*").cast("double").alias("total")).withColumn("_j", F.lit(0))
    per = ex.groupBy("target").agg(F.count("*").cast("double").alias("p")).withColumn("_j", F.lit(0)).join(F.broadcast(size), "_j")
    c = covered.select(rule, "ex").distinct().join(ex, "ex")
    n = c.groupBy(rule).agg(F.count("*").cast("double").alias("n"))
    tp = c.groupBy(rule, "target").agg(F.count("*").cast("double").alias("tp"))
    return tp.join(n, rule).join(F.broadcast(per), "target").select(rule, "target", "tp", "n", "p", "total")


def with_scores(counts: DataFrame, names: list[str] | None = None) -> DataFrame:
    tp, n, p, size = (F.col(c) for c in ("tp", "n", "p", "total"))
    for name in names or list(SCORES):
        if name not in SCORES:
            raise ValueError(f"no score {name!r}")
        value = SCORES[name](tp, n, p, size)
        if name == "chisq":
            value = F.when((n < size) & (p < size), SCORES[name](tp, n, p, F.when((n < size) & (p < size), size))).otherwise(0.0)
        counts = counts.withColumn(name, value)
    return counts


def numeric_scores(covered: DataFrame, examples: DataFrame, rule: str = "rule") -> DataFrame:
    """(rule, n, mean, z, t) for examples (ex, score): the covered mean against all."""
    every = examples.agg(F.avg("score").alias("m"), F.stddev_pop("score").alias("s"), F.count("*").alias("total")).withColumn("_j", F.lit(0))
    c = covered.select(rule, "ex").distinct().join(examples.select("ex", "score"), "ex").groupBy(rule).agg(F.count("*").alias("n"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("sd")).withColumn("_j", F.lit(0))
    c = c.join(F.broadcast(every), "_j")
    z = F.sqrt("n") * (F.col("mean") - F.col("m")) / F.when(F.col("s") > 0, F.col("s"))
    t = F.sqrt("n") * (F.col("mean") - F.col("m")) / F.when(F.col("sd") > 0, F.col("sd"))
    return c.select(rule, "n", "mean", z.alias("z"), t.alias("t"))


def enrichment_scores(covered: DataFrame, examples: DataFrame, rule: str = "rule") -> DataFrame:
    """(rule, es): greatest rise of the running sum over examples by falling |score|, up by a covered one's share, down evenly otherwise. Only the covered
    ranks are visited: between them the sum falls in a straight line."""
    ex = examples.select("ex", F.abs("score").alias("s")).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("s"), "ex")))
    size = examples.agg(F.count("*").alias("total")).withColumn("_j", F.lit(0))
    c = covered.select(rule, "ex").distinct().join(ex, "ex")
    w, run = Window.partitionBy(rule), Window.partitionBy(rule).orderBy("rank")
    c = c.select(rule, "rank", (F.sum("s").over(run) / F.sum("s").over(w)).alias("hit"), F.row_number().over(run).alias("k"), F.count("*").over(w).alias("n")).withColumn("_j", F.lit(0)).join(F.broadcast(size), "_j")
    return c.groupBy(rule).agg(F.max(F.col("hit") - (F.col("rank") - F.col("k")) / F.greatest(F.col("total") - F.col("n"), F.lit(1))).alias("es"))


def kaplan_meier_auc(covered: DataFrame, examples: DataFrame, rule: str = "rule") -> DataFrame:
    """(rule, auc): area under the Kaplan-Meier curve of the covered examples (ex, time, event)."""
    c = covered.select(rule, "ex").distinct().join(examples.select("ex", "time", "event"), "ex").groupBy(rule, "time").agg(F.count("*").alias("n"), F.sum(F.col("event").cast("int")).alias("d"))
    back = Window.partitionBy(rule).orderBy(F.desc("time")).rowsBetween(Window.unboundedPreceding, 0)
    run = Window.partitionBy(rule).orderBy("time")
    c = c.withColumn("risk", F.sum("n").over(back)).withColumn("f", 1 - F.col("d") / F.col("risk"))
    # A product by logarithms; once a factor is 0 the curve stays there.
    c = c.withColumn("s", F.when(F.max((F.col("f") == 0).cast("int")).over(run) == 1, 0.0).otherwise(F.exp(F.sum(F.ln(F.when(F.col("f") > 0, F.col("f")))).over(run))))
    before = F.coalesce(F.lag("s").over(run), F.lit(1.0))
    return c.withColumn("step", before * (F.col("time") - F.coalesce(F.lag("time").over(run), F.lit(0.0)))).groupBy(rule).agg(F.sum("step").alias("auc"))


def interesting(scored: DataFrame, score: str) -> DataFrame:
    low, high = BOUNDS[score]
    return scored.where((F.col(score) > low) & (F.col(score) <= high))


# Learners

SEP = " & "


def pairs_of(membership: DataFrame) -> DataFrame:
    """(rule, ex) for every conjunction of two predicates."""
    a, b = membership.toDF("p", "ex"), membership.toDF("q", "ex")
    return a.join(b, "ex").where("p < q").select(F.concat_ws(SEP, "p", "q").alias("rule"), "ex")


def supported(covered: DataFrame, least: int, rule: str = "rule") -> DataFrame:
    """Covers of the rules with enough examples."""
    return covered.join(covered.groupBy(rule).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(rule), rule, "left_semi")


def optimal_learner(membership: DataFrame, examples: DataFrame, depth: int = 2, least: int = 1, score: str = "lift", n: int = 20) -> DataFrame:
    """Best n rules of each target among all conjunctions up to depth with enough support, built level by level from supported ones."""
    m = cut(supported(membership.select(F.col("pred").alias("rule"), "ex").distinct(), least), "base")
    now, every = m.withColumn("last", F.col("rule")), m
    for _ in range(1, depth):
        wider = now.join(m.toDF("p", "ex"), "ex").where("p > last").select(F.concat_ws(SEP, "rule", "p").alias("rule"), "ex", F.col("p").alias("last"))
        now = cut(supported(wider, least), "wider")
        if now.isEmpty():
            break
        every = every.unionByName(now.select("rule", "ex"))
    scored = with_scores(rule_counts(every, examples), [score])
    w = Window.partitionBy("target").orderBy(F.desc(score), F.desc("n"), "rule")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def beam_learner(membership: DataFrame, examples: DataFrame, subclass_of: DataFrame | None = None, target: str | None = None, settings: Defaults | None = None) -> list[dict]:
    """Beam search for one target: each level swaps a predicate for a subclass or appends one, all candidates are counted in one
    job, the best are kept, and it stops when their scores' sum gains less than a hundredth. Rules of the same cover are taken once."""
    s = settings or Defaults()
    total = examples.count()
    least = max(1, int(s.support * total))
    m = cut(supported(membership.select(F.col("pred").alias("rule"), "ex").distinct(), least), "members")
    if target is None:
        target = examples.groupBy("label").count().orderBy(F.desc("count"), "label").first()["label"]
    down = {}
    if subclass_of is not None:
        for c, p in subclass_of.select("child", "parent").distinct().toLocalIterator():
            down.setdefault(p, []).append(c)
    preds = [r[0] for r in m.select("rule").distinct().orderBy("rule").collect()]
    spark = membership.sparkSession

    def judge(rules: list[tuple[str, ...]]) -> list[dict]:
        if not rules:
            return []
        wanted = spark.createDataFrame([(SEP.join(r), p, len(r)) for r in rules for p in r], "name string, rule string, k int")
        cover = m.join(F.broadcast(wanted), "rule").groupBy("name", "ex", "k").agg(F.count("*").alias("c")).where("c = k").select(F.col("name").alias("rule"), "ex")
        prints = cover.groupBy("rule").agg(F.sum(F.xxhash64("ex").cast("decimal(38,0)")).alias("print"))
        got = with_scores(rule_counts(cover, examples), [s.score]).where((F.col("target") == target) & (F.col("n") >= least)).join(prints, "rule")
        best: dict = {}
        for r in got.collect():
            key, row = r["print"], r.asDict() | {"predicates": tuple(r["rule"].split(SEP))}
            if key not in best or (len(row["predicates"]), row["rule"]) < (len(best[key]["predicates"]), best[key]["rule"]):
                best[key] = row
        return sorted(best.values(), key=lambda r: (-r[s.score], r["rule"]))

    beam = judge([(p,) for p in preds])[: s.beam]
    for _ in range(1, s.depth):
        wider = set()
        for r in beam:
            have = r["predicates"]
            wider |= {tuple(sorted({*have, p})) for p in preds if p not in have}
            wider |= {tuple(sorted({*(q for q in have if q != p), c})) for p in have for c in down.get(p, ())}
        new = {r["print"]: r for r in reversed(beam + judge(sorted(wider)))}
        best = sorted(new.values(), key=lambda r: (-r[s.score], len(r["predicates"]), r["rule"]))[: s.beam]
        before, after = sum(r[s.score] for r in beam), sum(r[s.score] for r in best)
        beam = best
        if not after or 1 - abs(before / after) < 0.01:
            break
    return beam


def validate(rules: list[dict], adjust: str = "fwer", alpha: float = 0.05, q: float = 0.01) -> list[dict]:
    """Rules with p of a one-sided exact test that stay after the adjustment (none, fwer: Holm, fdr: stepwise)."""
    for r in rules:
        tp, n, p, size = (int(r[k]) for k in ("tp", "n", "p", "total"))
        r["p_value"] = fisher_exact(tp, n - tp, p - tp, size - n - p + tp, "greater")
    rules = sorted(rules, key=lambda r: r["p_value"])
    m, out = len(rules), []
    for k, r in enumerate(rules, 1):
        if adjust == "fwer" and r["p_value"] > alpha / (m + 1 - k) or adjust == "fdr" and r["p_value"] > k * q / m:
            break
        out.append(r)
    return out


def report(rules: list[dict], target: str) -> str:
    lines = [f"'{target}'"]
    lines += [f"  {SEP.join(r['predicates'])} [cov={int(r['n'])}, pos={int(r['tp'])}" + "".join(f", {k}={r[k]:.3f}" for k in (*SCORES, "p_value") if k in r) + "]" for r in rules]
    return "\n".join(lines)


def rules_json(rules_by_target: dict[str, list[dict]]) -> dict:
    return {t: [{"rule": list(r["predicates"]), "coverage": int(r["n"]), "positives": int(r["tp"])} for r in rs] for t, rs in rules_by_target.items()}


def run(membership: DataFrame, examples: DataFrame, subclass_of: DataFrame | None = None, settings: Defaults | None = None) -> dict[str, list[dict]]:
    """Rules for every target class, validated."""
    s = settings or Defaults()
    closed = member_closure(membership, subclass_of) if subclass_of is not None else membership
    closed = cut(closed, "closed")
    targets = [r[0] for r in examples.select("label").distinct().orderBy("label").collect()]
    return {t: validate(beam_learner(closed, examples, subclass_of, t, s), s.adjust, s.alpha, s.q) for t in targets}


def community_rules(partition: DataFrame, annotations: DataFrame, settings: Defaults | None = None) -> dict[str, list[dict]]:
    """Rules that describe communities by their members' terms. partition: (node, community); annotations: (entity, term)."""
    ex = partition.select(F.col("node").alias("ex"), F.concat(F.col("community").cast("string"), F.lit("_community")).alias("label"))
    return run(annotations.select(F.col("term").alias("pred"), F.col("entity").alias("ex")).distinct(), ex, None, settings)
