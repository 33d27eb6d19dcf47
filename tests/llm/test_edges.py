"""Each operator on nulls, empty and very long texts, ties, repeated rows, extra columns, and no rows."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ringwatch.llm import fingerprint, jaccard, lm, neighbours, packing, pii, quality, resample, rules, sharding, tokenfile, unigram
from ringwatch.llm.registry import BYTE_BPE, PII_KEY, PIECES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `group` string, rank int, shard int, length int, start string, component string, _bucket int"
LONG = "lorem ipsum dolor sit amet " * 6000
TEXTS = [None, "", " \n\t ", "a", "one two three four five six seven", "one two three four five six seven", "don't  ▁ 日本 <|endoftext|>", LONG, LONG, "x" * 3000, "4111 1111 1111 1111 and 2024-02-29"]
ROWS = [(i, t, None if i == 3 else "en", None if i == 4 else "s", None if i == 5 else len(t or ""), "g", 1, 2, 3, "s", "c", 0) for i, t in enumerate(TEXTS)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (9, 0, 0), (7, 1, 0), (2, None, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


OPERATORS = {
    "shards": lambda d, _: sharding.assign(d, 4),
    "pii": lambda d, _: pii.pseudonymize(d, PII_KEY),
    "pieces": lambda d, _: unigram.encode(d, PIECES, chunk=5000),
    "tokens": lambda d, _: tokenfile.read(tokenfile.rebase(tokenfile.write(d, BYTE_BPE, 2, shards=3))),
    "quality": lambda d, labels: quality.classify(d, labels),
    "fingerprints": lambda d, _: fingerprint.fingerprints(d),
    "jaccard": lambda d, _: jaccard.join(d, 4, 85),
    "packing": lambda d, _: packing.pack(d, BYTE_BPE),
    "lm": lambda d, _: lm.score(d),
    "resample": lambda d, _: resample.resample(d, d.limit(3), 50),
    "rules": lambda d, _: rules.judged(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_hard_rows(docs, labels, name):
    rows = OPERATORS[name](docs, labels).collect()
    assert {r["doc_id"] for r in rows} == set(range(len(TEXTS)))
    if name != "packing":
        assert len(rows) == len(TEXTS)


@pytest.mark.parametrize("name", OPERATORS)
def test_no_rows(empty, labels, name):
    assert OPERATORS[name](empty, labels).isEmpty()


@pytest.mark.parametrize("name", ["shards", "tokens", "fingerprints", "pieces", "pii", "quality", "resample", "rules"])
def test_repeated_rows_stay(docs, labels, name):
    few = docs.where("doc_id IN (4, 5, 10)")
    assert OPERATORS[name](few.unionByName(few), labels).count() == 6


def test_null_ids(spark, docs, labels):
    odd = docs.where("doc_id = 4").withColumn("doc_id", F.lit(None).cast("long")).unionByName(docs.where("doc_id = 1"))
    for name in ("shards", "tokens", "fingerprints", "pieces", "pii", "packing", "quality", "resample", "rules"):
        assert OPERATORS[name](odd, labels).count() == 2, name
    for name in ("jaccard", "lm"):
        assert OPERATORS[name](odd, labels).count() == 1, name


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (20, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.0, 0.0], 1), (3, None, 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 1), (6, [None, 1.0], 1), (None, [1.0, 1.0], 1), (7, [0.5, 0.5], 1), (8, [], 1), (1, [1.0, 0.0], 1), (9, [1.0, 2.0, 3.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, block int")
    got = neighbours.search(df, F.col("vec_id") % 20 == 0, k=20).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in got] == [(0, 1, 1.0), (0, 20, 1.0), (0, 7, 0.5), (20, 0, 1.0), (20, 1, 1.0), (20, 7, 0.5)]
    assert neighbours.search(df.limit(0), F.col("vec_id") % 20 == 0).isEmpty()


def test_pipeline_on_hard_rows(spark, docs, labels, empty, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for source in (docs, empty):
        df, names = source, source.columns
        for name, stage in corpus_pipeline.STAGES:
            df = stage(spark, df, str(tmp_path))
            if name != "packing":
                assert df.columns == names
        df.collect()
