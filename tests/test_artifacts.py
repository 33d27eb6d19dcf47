"""Rounding, canonical JSON, digests, curve files."""

import hashlib
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from ringwatch.operators import artifacts


@pytest.mark.parametrize("places", [0, 4, 6, 10])
def test_rounding_is_pythons(spark, places):
    rng = random.Random(places)
    hard = [0.0, -0.0, 0.5, 1.5, 2.5, 2.675, 1.005, 0.00005, 0.00015, 0.000125, 0.125, -2.675, 1e-300, 5e-324, 123456789.123456789, 4503599627370495.5, 4503599627370497.0, 1e300, math.inf, -math.inf]
    hard += [k / 10 ** (places + 1) for k in range(5, 2000, 10)] + [(k + 0.5) / 2**j for j in range(1, 20) for k in range(0, 40)] + [rng.random() * 10 ** rng.randrange(-12, 12) * rng.choice((1, -1)) for _ in range(3000)]
    hard += [math.nextafter(x, d) for x in hard[8:400] if math.isfinite(x) for d in (math.inf, -math.inf)]
    rows = spark.createDataFrame([(x,) for x in [*hard, None]], "x double").select("x", artifacts.rounded(F.col("x"), places).alias("r")).collect()
    for r in rows:
        want = r["x"] if r["x"] is None or math.isinf(r["x"]) else round(r["x"], places)
        assert r["r"] == want, (r["x"], r["r"], want)
    nan = spark.sql("SELECT double('NaN') x").select(artifacts.rounded(F.col("x"), places)).first()[0]
    assert math.isnan(nan)


def test_canonical_json_is_the_drivers(spark):
    payloads = [{"b": 1, "a": {"z": None, "y": [1, {"d": True, "c": "é\"\\\n"}]}}, {"": "", "ключ": "значение", "k": 12345678901}, [], [[], {}], "text", 3, {"n": -1.5, "Z": 1, "a": 2, "_": 3}]
    texts = [json.dumps(p, ensure_ascii=False, indent=1) for p in payloads]
    rows = spark.createDataFrame([(t,) for t in [*texts, "{broken", None]], "t string").select(artifacts.canonical_json(F.col("t")).alias("j"), artifacts.json_digest(F.col("t")).alias("d")).collect()
    for p, r in zip(payloads, rows, strict=False):
        want = json.dumps(p, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        assert (r["j"], r["d"]) == (want, hashlib.sha256(want.encode()).hexdigest())
    assert [r["j"] for r in rows[-2:]] == [None, None]


def test_typed_digests_tell_types_and_ignore_order(spark):
    df = spark.sql("SELECT 1 a, '1' b, CAST(NULL AS string) c")
    one = lambda f: df.select(artifacts.typed_digest("d", f)).first()[0]
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    assert one({"x": a, "y": b}) == one({"y": b, "x": a}) and len({one({"x": v}) for v in (a, b, c)}) == 3
    assert df.select(artifacts.attributes({"x": a, "y": c, "z": b}).alias("m")).first()["m"] == {"x": "1", "z": "1"}


def test_curve_files(spark):
    df = spark.createDataFrame([(200, 0.1 + 0.2, "b"), (100, 1 / 3, "a"), (50, None, "b")], "draws int, half_width double, scope string")
    text, table = artifacts.curve_files(df, "draws", "scope")
    assert [(p["x"], p["label"], p["values"]["half_width"]) for p in json.loads(text)["points"]] == [(100, "a", 0.3333333333), (50, "b", None), (200, "b", 0.3)]
    assert table == "draws,scope,half_width\n100,a,0.3333333333\n50,b,\n200,b,0.3\n"
