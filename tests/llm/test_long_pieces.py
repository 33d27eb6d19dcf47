import re

from ringwatch.llm import unigram
from ringwatch.llm.registry import PIECES


def test_long_texts_travel_only_as_chunks(spark):
    text = "many words of a long text " * 400
    df = spark.createDataFrame([(1, text), (1, text), (None, text + "end"), (2, "short")], "doc_id long, text string")
    coded = unigram.encode(df, PIECES)
    rows = coded.collect()
    assert sorted((r["doc_id"] or 0, r["n_chars"]) for r in rows) == [(0, len(text) + 3), (1, len(text)), (1, len(text)), (2, 5)]
    assert all(r["text_crc32"] == r["decoded_crc32"] and r["n_tokens"] == len(r["ids"]) for r in rows)
    plan = coded._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Exchange.*\n.*text#", plan) and "md5(" not in plan
