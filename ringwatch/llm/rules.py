"""Quality of texts by weak supervision: rules vote or abstain, and their accuracies are estimated from the votes alone.

Each rule votes for a text (1), against it (-1) or abstains (0). A text is good or poor; given which, rules vote independently. A rule has two accuracies,
its share of votes for among the good texts it votes on and of votes against among the poor ones. Expectation-maximisation estimates
them and the share of good texts: every round weighs each pattern of votes (at most 3 ** rules of them, counted over
all documents) by its posterior, and counts anew. A text is kept where its posterior probability of being good is at least one half, so one
unreliable rule does not reject it and several weak ones may. Two base checks come first: texts below ``LEAST`` words, and texts of which more than
``REPEATED`` percent of words lie in repeated windows of 8 words, fail whatever the votes say.

Everything is DataFrame functions; a text's words are never rows. The driver holds the model's 17 numbers. Texts are read once; what is counted in them is stored.

Nulls: a null text is empty; it has no words and fails. A null doc_id is kept as null. Repeated rows are rows of their own, with equal results, and count as often as
they occur in the estimates. A very long text is one row. A posterior of exactly one half keeps. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringwatch.llm.common import only, saved

WINDOW, LEAST, REPEATED = 8, 20, 30
SYMBOLS, CAPITALS, MARKS = "#*$%&|<>", string.ascii_uppercase, string.punctuation
ROUNDS = 25
#: Where the estimates begin: the share of good texts, a rule's accuracy on good texts and on poor ones: a good text breaks hardly any rule, a poor one only some.
START = (0.8, 0.995, 0.3)


def _joined(a: str, step: int) -> Column:
    """Hashes of each element with the one ``step`` places on."""
    return F.transform(a, lambda x, i: F.xxhash64(x, F.get(F.col(a), i + step)))


def _all_but(a: Column, last: int) -> Column:
    return F.slice(a, F.lit(1), F.greatest(F.size(a) - last, F.lit(0)))


def counted(docs: DataFrame) -> DataFrame:
    """doc_id and what the rules look at: counts of words, characters, lines, repeats."""
    df = only(docs, "doc_id", "text").select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    gone = lambda chars: (F.length("text") - F.length(F.translate(F.col("text"), chars, ""))).cast("long")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("_l", lines).withColumn("_w", F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    df = df.select(
        "doc_id", "_w", F.size("_w").cast("long").alias("n_words"), F.aggregate("_w", F.lit(0).cast("long"), lambda n, x: n + F.length(x)).alias("word_chars"),
        gone(SYMBOLS).alias("n_symbols"), gone(CAPITALS).alias("n_capitals"), gone(MARKS).alias("n_marks"),
        F.size("_l").cast("long").alias("n_lines"), (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
    )
    df = df.withColumn("_1", F.transform("_w", lambda x: F.xxhash64(x))).drop("_w")
    df = df.withColumn("_2", _joined("_1", 1)).drop("_1").withColumn("n_pairs", F.size(F.array_distinct(_all_but(F.col("_2"), 1))).cast("long"))
    df = df.withColumn("_4", _joined("_2", 2)).drop("_2").withColumn("_8", _joined("_4", 4)).drop("_4").withColumn("_8", _all_but(F.col("_8"), WINDOW - 1))
    # Windows found twice or more: neighbours in order of their hashes. Only texts that have any are sorted.
    df = df.withColumn("_s", F.when(F.size(F.array_distinct("_8")) < F.size("_8"), F.array_sort(F.transform("_8", lambda x, i: F.struct(x.alias("x"), i.alias("i")))))).drop("_8")
    twice = lambda e, i: F.coalesce(e["x"] == F.get(F.col("_s"), i - 1)["x"], F.lit(False)) | F.coalesce(e["x"] == F.get(F.col("_s"), i + 1)["x"], F.lit(False))
    df = df.withColumn("_p", F.array_sort(F.transform(F.filter("_s", twice), lambda e: e["i"]))).drop("_s")
    covered = F.transform("_p", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("_p"), i + 1) - p, F.lit(WINDOW))))
    return df.withColumn("n_repeat_words", F.coalesce(F.aggregate(covered, F.lit(0).cast("long"), lambda n, x: n + x), F.lit(0).cast("long"))).drop("_p")


#: Rules by name: what makes each vote against and for a text, in terms of its counts.
RULES = {
    "long_enough": ("n_words < 20", "n_words >= 100"),
    "few_symbols": ("100 * n_symbols > 10 * n_words", "100 * n_symbols <= n_words"),
    "few_repeats": ("100 * n_repeat_words > 20 * n_words", "n_repeat_words = 0 AND n_words >= 20"),
    "lines_differ": ("100 * n_dup_lines > 20 * n_lines", "n_dup_lines = 0 AND n_lines >= 3"),
    "few_capitals": ("100 * n_capitals > 30 * word_chars", "100 * n_capitals <= 10 * word_chars"),
    "few_marks": ("100 * n_marks > 12 * word_chars", "100 * n_marks <= 6 * word_chars"),
    "pairs_differ": ("100 * n_pairs < 40 * (n_words - 1)", "100 * n_pairs >= 70 * (n_words - 1) AND n_words >= 20"),
    "word_length": ("word_chars > 12 * n_words OR word_chars < 3 * n_words", "word_chars BETWEEN 4 * n_words AND 9 * n_words"),
}
_VOTES = [f"v_{r}" for r in RULES]


class Model:
    """The share of good texts and each rule's accuracy on good and on poor ones."""

    def __init__(self, share: float, good: list[float], poor: list[float]):
        self.share, self.good, self.poor = share, good, poor

    def posterior(self) -> Column:
        """Probability that the text of a row of votes is good."""
        odds = F.lit(math.log(self.share) - math.log(1 - self.share))
        for v, a, b in zip(_VOTES, self.good, self.poor, strict=True):
            odds = odds + F.when(F.col(v) > 0, math.log(a) - math.log(1 - b)).when(F.col(v) < 0, math.log(1 - a) - math.log(b)).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-odds))


def fitted(votes: DataFrame, rounds: int = ROUNDS) -> Model:
    """The model after ``rounds`` of expectation-maximisation over the patterns of votes; counts are smoothed by one of each kind."""
    patterns = saved(votes.groupBy(*_VOTES).agg(F.count(F.lit(1)).alias("n")).coalesce(1).sortWithinPartitions(*_VOTES), "patterns")
    model = Model(START[0], [START[1]] * len(_VOTES), [START[2]] * len(_VOTES))
    for _ in range(rounds):
        good = F.col("n") * F.col("_p")
        poor = F.col("n") * (1 - F.col("_p"))
        sums = [F.sum(good), F.sum(poor)]
        for v in _VOTES:
            sums += [F.sum(F.when(F.col(v) > 0, good)), F.sum(F.when(F.col(v) < 0, good)), F.sum(F.when(F.col(v) > 0, poor)), F.sum(F.when(F.col(v) < 0, poor))]
        row = [x or 0.0 for x in patterns.withColumn("_p", model.posterior()).agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()]
        each = [row[i : i + 4] for i in range(2, len(row), 4)]
        model = Model((row[0] + 1) / (row[0] + row[1] + 2), [(a + 1) / (a + b + 2) for a, b, _, _ in each], [(d + 1) / (c + d + 2) for _, _, c, d in each])
    return model


def judged(docs: DataFrame) -> DataFrame:
    """Every document's counts, votes, posterior ``quality``, base_failed and kept."""
    votes = {f"v_{r}": F.when(F.expr(no), -1).when(F.expr(yes), 1).otherwise(0) for r, (no, yes) in RULES.items()}
    votes = saved(counted(docs).withColumns(votes), "votes")
    failed = (F.col("n_words") < LEAST) | (100 * F.col("n_repeat_words") > REPEATED * F.col("n_words"))
    out = votes.withColumn("quality", fitted(votes).posterior()).withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5))
