"""The near-duplicate stage on repeated rows, null ids, and one id with two texts, against brute force."""

import corpus_pipeline

A, B, C = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
ROWS = [(1, A), (1, A), (2, A + " end"), (None, A), (None, B), (None, B), (3, C), (3, B), (4, ""), (4, ""), (5, ""), (None, None), (6, C + " end"), (7, "alone here")]


def _kept(rows, words=5):
    def shingles(t):
        w = (t or "").split()
        return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} or ({tuple(w)} if w else set())

    out = []
    for doc, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        s = shingles(text)
        if s and any(len(s & shingles(t)) >= 0.8 * len(s | shingles(t)) for _, t in out):
            continue
        if not s and doc is not None and (doc, text) in out:
            continue
        out.append((doc, text))
    return out


def test_one_row_of_each_group_stays(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    got = [tuple(r) for r in corpus_pipeline.distinct(spark, df, "").collect()]
    order = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted(got, key=order) == sorted(_kept(ROWS), key=order)
