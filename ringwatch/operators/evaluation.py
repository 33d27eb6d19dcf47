"""Classifier evaluation: per-class metrics, paired deltas, the regression gate, parsing of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringwatch.operators.draws import inverted, with_distribution
from ringwatch.operators.measurement import uniform

#: The gate's tolerances.
RECALL_DROP, F1_DROP, UNPARSEABLE = 0.25, 0.10, 0


def parse_class(text: Column, classes: list[str]) -> Column:
    """The class a ``CLASS:`` line names, if there is exactly one such line and it names a legal one."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x).startswith("CLASS:"))
    named = F.lower(F.trim(F.substring(F.trim(F.get(lines, 0)), 7, 64)))
    return F.when((F.size(lines) == 1) & named.isin(classes), named)


def class_metrics(items: DataFrame, classes: list[str]) -> DataFrame:
    """Support, predictions, true positives, precision, recall and F1; items have truth and predicted (null: unparseable)."""
    # Each item gives one row a side, pre-aggregated before the exchange.
    sides = items.select(F.explode(F.array(F.struct(F.col("truth").alias("c"), F.lit(1).alias("s"), F.lit(0).alias("p"), F.lit(0).alias("t")), F.struct(F.col("predicted").alias("c"), F.lit(0).alias("s"), F.lit(1).alias("p"), F.when(F.col("truth") == F.col("predicted"), 1).otherwise(0).alias("t")))).alias("x"))
    counts = sides.select("x.*").where("c is not null").groupBy(F.col("c").alias("threat_class")).agg(F.sum("s").alias("support"), F.sum("p").alias("predicted"), F.sum("t").alias("true_positives"))
    names = items.sparkSession.createDataFrame([(c,) for c in classes], "threat_class string")
    df = names.join(counts, "threat_class", "left").fillna(0)
    over = lambda n: F.when(F.col(n) > 0, F.col("true_positives") / F.col(n)).otherwise(0.0)
    df = df.withColumn("precision", over("predicted")).withColumn("recall", over("support"))
    both = F.col("precision") + F.col("recall")
    return df.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0))


def macro_f1(metrics: DataFrame) -> DataFrame:
    seen = metrics.where("support > 0")
    return seen.agg(F.avg("f1").alias("macro_f1"), F.count(F.lit(1)).alias("classes"))


def paired(incumbent: DataFrame, candidate: DataFrame) -> DataFrame:
    """Items with both answers; an item that only one side has is an error."""
    a, b = incumbent.select("item_id", "truth", F.col("predicted").alias("before")), candidate.select("item_id", F.col("predicted").alias("after"), F.lit(1).alias("_b"))
    both = a.withColumn("_a", F.lit(1)).join(b, "item_id", "full_outer")
    guard = F.when(F.col("_a").isNull() | F.col("_b").isNull(), F.raise_error(F.concat(F.lit("unpaired item "), F.col("item_id").cast("string")))).otherwise(F.col("truth"))
    return both.select("item_id", guard.alias("truth"), "before", "after")


def recall_deltas(pairs: DataFrame, replicates: int, seed: str, alpha: float = 0.05) -> DataFrame:
    """Observed change of each class's recall and its paired bootstrap interval.

    A class's differences are -1, 0 or 1, so a replicate is a multinomial draw over three counts: the ups are binomial, and given
    them so are the downs. Both are drawn by inversion, a row for each replicate and class; a distribution is worked out once for each count of ups.
    """
    d = F.when(F.col("after") == F.col("truth"), 1).otherwise(0) - F.when(F.col("before") == F.col("truth"), 1).otherwise(0)
    counts = pairs.groupBy(F.col("truth").alias("threat_class")).agg(F.count(F.lit(1)).alias("n"), F.count_if(d == 1).alias("up"), F.count_if(d == -1).alias("down"))
    first = with_distribution(counts.withColumn("p", F.col("up") / F.col("n")), "n", "p").withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    ups = first.select("threat_class", "n", "up", "down", "replicate", inverted(uniform(f"{seed}:up", F.col("threat_class"), F.col("replicate"))).alias("ups"))
    rest = ups.select("threat_class", "n", "up", "down", "ups").distinct().withColumn("left", F.col("n") - F.col("ups"))
    rest = rest.withColumn("p", F.when(F.col("n") > F.col("up"), F.col("down") / (F.col("n") - F.col("up"))).otherwise(0.0))
    known = with_distribution(rest, "left", "p").select("threat_class", "ups", "low", "upto")
    downs = inverted(uniform(f"{seed}:down", F.col("threat_class"), F.col("replicate")))
    sums = ups.join(known, ["threat_class", "ups"]).withColumn("x", (F.col("ups") - downs) / F.col("n"))
    out = sums.groupBy("threat_class", "n", "up", "down")
    return out.agg(F.expr(f"percentile(x, {alpha / 2})").alias("low"), F.expr(f"percentile(x, {1 - alpha / 2})").alias("high")).select("threat_class", F.col("n").alias("support"), ((F.col("up") - F.col("down")) / F.col("n")).alias("delta"), "low", "high")


def detectable(deltas: DataFrame) -> DataFrame:
    """Half width of each supported class's interval: the least drop the eval set can show."""
    return deltas.where("support > 0").select("threat_class", ((F.col("high") - F.col("low")) / 2).alias("half_width"))


def breaches(deltas: DataFrame, f1_before: float, f1_after: float, unparseable: int) -> DataFrame:
    """Every reason to refuse a candidate, none left out."""
    code = F.when(F.col("delta") < -RECALL_DROP, "recall_regression").otherwise("recall_not_excluded")
    out = deltas.where(F.col("low") < -RECALL_DROP).select(code.alias("code"), F.col("threat_class").alias("subject"), F.col("low").alias("value"))
    more = [("macro_f1_regression", "all", f1_after - f1_before)] if f1_before - f1_after > F1_DROP else []
    more += [("unparseable", "all", float(unparseable))] if unparseable > UNPARSEABLE else []
    return out.unionByName(deltas.sparkSession.createDataFrame(more, "code string, subject string, value double")) if more else out


def minimal(metrics: DataFrame) -> DataFrame:
    """Class balance, largest first."""
    return metrics.select("threat_class", "support").orderBy(F.desc("support"), "threat_class")
