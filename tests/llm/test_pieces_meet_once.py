import re

from ringwatch.llm import unigram
from ringwatch.llm.registry import PIECES


def test_ids_of_long_texts_meet_in_one_exchange_without_a_join(spark):
    df = spark.createDataFrame([(1, "many words of a long text\n" * 400), (2, "日本" * 5000), (3, "line\n" * 3000)], "doc_id long, text string")
    coded = unigram.encode(df, PIECES)
    assert sorted(r["doc_id"] for r in coded.where("text_crc32 = decoded_crc32").collect()) == [1, 2, 3]
    plan = coded._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert len(re.findall(r"Exchange hash", plan)) == 1 and "Join" not in plan


def test_a_chunk_is_cut_at_line_breaks_too():
    words = unigram.Vocabulary(PIECES)
    text = "a" * 40 + "\n" + "b" * 30 + "\n" + "c" * 20
    assert words.cuts(text, len(text)) == (40, 71)
    assert words.cuts("x" * 20 + "  " + "y" * 9, 31) == (20, 20)
    assert words.cuts("z" * 99, 80) == (80, 80)
    whole = unigram.boundary_states(words.transfer(text, len(text))[None])
    assert words.transfer(text, len(text))[whole[0], whole[1]] == words.best(text)[0]
