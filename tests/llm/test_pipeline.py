"""The pipeline against plain versions of its stages."""

import hashlib
import itertools
import random
from collections import Counter

import corpus_pipeline
import pytest
from laminet.llm import langid, mixing
from pyspark.sql import functions as F

from tests.llm.test_operators import DOCS, bag, edited, jaccard, plain_all, prose


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    r, base = random.Random(1), prose(200, 9)
    texts = [None, "", "123 456", *[prose(r.randint(5, 80), i) + "\n" + prose(30, 1000 + i // 3) for i in range(60)], base, base, *[edited(base, 3, i) for i in range(8)]]
    rows = [(i, t, "en", f"s{i % 4}" if i % 5 else None, len(t or "")) for i, t in enumerate(texts)]
    d = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, DOCS).write.parquet(f"{d}/documents.parquet")
    return str(d)


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language ID", "line dedup", "MinHash near-dedup", "mixing", "byte-level BPE"]
    docs = stages["language ID"](spark, docs, sf_dir)
    kept = {r.doc_id: r.text for r in docs.collect()}
    assert kept == {i: t for i, t in before.items() if t and any(c.isalpha() for c in t)}
    docs = stages["line dedup"](spark, docs, sf_dir)
    ids = sorted(kept)
    plain = dict(zip(ids, plain_all([kept[i] for i in ids]).values()))
    lined = {r.doc_id: r.text for r in docs.collect()}
    assert lined == {i: t for i, t in plain.items() if t.strip()}
    docs = stages["MinHash near-dedup"](spark, docs, sf_dir)
    single = {r.doc_id: r.text for r in docs.collect()}
    for a, b in itertools.combinations(sorted(single), 2):
        assert jaccard(bag(single[a]), bag(single[b])) < 0.8
    assert all(any(jaccard(bag(lined[i]), bag(lined[j])) >= 0.8 for j in lined if j != i) for i in lined if i not in single)
    docs.write.mode("overwrite").parquet(f"{sf_dir}/single.parquet")
    docs = spark.read.parquet(f"{sf_dir}/single.parquet")
    assert docs.columns == corpus_pipeline.COLUMNS
    mixed = stages["mixing"](spark, docs, sf_dir)
    copies = Counter(r.doc_id for r in mixed.collect())
    assert {i: n for i, n in copies.items()} == {r.doc_id: r.copies for r in mixing.mix(docs).collect() if r.copies}
    out = stages["byte-level BPE"](spark, mixed, sf_dir).collect()
    assert Counter(r.doc_id for r in out) == copies
    assert all(r.decoded_sha256 == hashlib.sha256(single[r.doc_id].encode()).hexdigest() for r in out)


def test_run_equals_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    run = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(str, run.collect())) == sorted(map(str, docs.collect()))


def test_bad_text_is_rejected(spark):
    m = langid.fit({"en": [prose(500, 3).encode()]})
    junk = "".join(random.Random(2).choices([chr(c) for c in range(0x4E00, 0x9F00)], k=200))
    bits = {r.doc_id: r.bits for r in langid.predict(spark.createDataFrame([(1, junk, "", "", 0), (2, prose(50, 4), "", "", 0)], DOCS), m).collect()}
    assert bits[1] > langid.REJECT_BITS > bits[2]


def test_stages_lose_no_text_to_shared_ids_nulls_or_names(spark, tmp_path):
    base, other = prose(60, 21), prose(60, 22)
    rows = [(1, base, "en", "a", 1), (2, base + " x", "en", "a", 1), (2, other, "en", None, 1), (None, prose(50, 23), None, None, None), (3, prose(30_000, 24), "en", "a", 1)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("id", F.lit(7)).withColumn("class_id", F.lit("x"))
    kept = {r.text for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert kept == {rows[i][1] for i in (0, 2, 3, 4)}
    assert {r.text for r in corpus_pipeline.lines(spark, docs, "").collect()} >= {other, rows[3][1]}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], DOCS), "").count() == 0, name
