"""The scan folds each text once, however many literals its screen looks for."""

from ringwatch.operators import textguard


def test_texts_are_folded_once(spark, capsys):
    df = spark.range(9).selectExpr("cast(id AS string) record_id", "concat(repeat('-', int(id)), ' begin') text")
    found = textguard.scan(df)
    found.explain()
    assert capsys.readouterr().out.count("translate(") == 1
    assert {(r["record_id"], r["offset"], r["length"]) for r in found.collect()} == {(str(i), 0, i + 6) for i in range(3, 9)}
