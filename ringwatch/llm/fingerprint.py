"""Closed syncmers over word pieces: context-free anchors with their places, and what texts share.

A text is a sequence of symbols: its lower-cased words cut into pieces of at most four
characters. A window of ``K`` symbols is chosen when the least hash among its inner windows of
``S`` symbols is at the window's first or last place. The choice depends on the window alone, so
an edit changes only the windows it touches. A text with
too few symbols for any window has one anchor, of all its symbols at place 0; one without symbols none.

A fingerprint is all anchors in order of their places, 8 hexadecimal digits each (half of their hash). The likeness of two is the
Jaccard index of their whole anchor sets. Two texts without anchors are alike (1.0); one against some is not (0.0).
``aligned_edited`` matches by position: the share of a text's anchors that the edited text has at the same place. ``places`` gives every
anchor as a row, for joins of texts at shared passages: a passage of two texts is anchors of both with one difference of places.

Nulls: a null text is the empty text; a null doc_id sorts first. Repeated rows keep their own
places in the order; rows alike in doc_id and text are alike in the result. A very long text is one row with as many anchors as it has; nothing is cut.
An empty table gives no rows. Extra columns are ignored. All work is DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ringwatch.llm.common import only

K, S = 5, 2
PIECE = r"[^\x20\x09-\x0D]{1,4}"


def _from(a: Column, i: int) -> Column:
    """``a`` without its first ``i`` elements and its last ones, as far as windows reach."""
    return F.slice(a, F.lit(i + 1), F.greatest(F.size(a) - F.lit(K - S), F.lit(0)))


def anchors(df: DataFrame, symbols: str, out: str) -> DataFrame:
    """Adds ``out``: (place, hash) of each chosen window over the array column ``symbols``.

    An array with fewer than K symbols gives none.
    """
    h, s = "_h", "_s"
    df = df.withColumn(h, F.transform(symbols, lambda x: F.xxhash64(x)))
    inner = F.zip_with(F.slice(h, 1, F.greatest(F.size(h) - 1, F.lit(0))), F.slice(h, 2, F.greatest(F.size(h) - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b))
    df = df.withColumn(s, F.when(F.size(h) >= K, inner).otherwise(F.array().cast("array<bigint>")))
    less = lambda a, b: F.least(a, b)
    low = F.zip_with(F.zip_with(_from(F.col(s), 0), _from(F.col(s), 1), less), F.zip_with(_from(F.col(s), 2), _from(F.col(s), 3), less), less)
    edge = lambda m, i: (m == F.get(F.col(s), i)) | (m == F.get(F.col(s), i + (K - S)))
    window = lambda i: F.xxhash64(F.get(F.col(s), i), F.get(F.col(s), i + 2), F.get(F.col(s), i + 3))
    chosen = F.transform(low, lambda m, i: F.when(edge(m, i), F.struct(i.alias("place"), window(i).alias("hash"))))
    return df.withColumn(out, F.filter(chosen, lambda x: x.isNotNull())).drop(h, s)


def anchored(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``: (place, hash) of all anchors of the text column."""
    df = df.withColumn("_w", F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(PIECE), F.lit(0)))
    whole = F.struct(F.lit(0).alias("place"), F.xxhash64(F.concat_ws(" ", "_w")).alias("hash"))
    df = anchors(df, "_w", "_a")
    return df.withColumn(out, F.when((F.size("_a") == 0) & (F.size("_w") > 0), F.array(whole)).otherwise(F.col("_a"))).drop("_w", "_a")


def places(docs: DataFrame) -> DataFrame:
    """(doc_id, place, hash) of every anchor of every text."""
    return anchored(only(docs, "doc_id", "text"), "text", "found").select("doc_id", F.explode("found").alias("x")).select("doc_id", "x.place", "x.hash")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard index of two arrays of hashes without repeats."""
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.when(union == 0, F.lit(1.0)).otherwise(shared / union)


def aligned(a: Column, b: Column) -> Column:
    """Share of the anchors ``a`` that ``b`` has at the same place."""
    # Strings meet in a hash set; structs would be compared each with each.
    keys = lambda x: F.transform(x, lambda y: F.concat_ws(":", y["place"].cast("string"), y["hash"].cast("string")))
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(keys(a), keys(b))) / F.size(a))


def printed(a: Column) -> Column:
    return F.concat_ws("", F.transform(a, lambda x: F.lpad(F.lower(F.hex(F.shiftrightunsigned(x["hash"], 32))), 8, "0")))


def with_next(docs: DataFrame, columns: list[str], known: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Adds what ``known`` adds, and ``next_<column>`` of the document before in doc_id order (the first gets the last's).

    Documents are dealt to ranges of doc_id and meet their neighbour inside a range; the last
    document of each range goes to the following range too. The bounds of ranges (at most
    20,000) and their last documents are all that is known of the whole corpus.
    """
    ids = only(docs, "doc_id")
    side = max(6, min(140, int((ids.count() / 300) ** 0.5)))
    cuts = ids.agg(F.percentile_approx("doc_id", [i / side**2 for i in range(1, side**2)], 100_000)).first()[0] or []
    cuts = cuts + cuts[-1:] * (side**2 - 1 - len(cuts)) if cuts else [0] * (side**2 - 1)
    rows = [cuts[i * side : (i + 1) * side - 1] for i in range(side)]
    tops = F.array(*[F.lit(c) for c in cuts[side - 1 :: side]])
    lists = F.array(*[F.array(*[F.lit(c) for c in r]) for r in rows])
    above = lambda a: F.size(F.filter(a, lambda b: b < F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))))
    coarse = above(tops)
    placed = docs.withColumn("_top", coarse).withColumn("_range", F.col("_top") * side + above(F.get(lists, F.col("_top")))).drop("_top")
    last = placed.groupBy("_range").agg(F.max("doc_id").alias("_last")).where("_last is not null")
    order = Window.orderBy("_range")  # one row a range: at most 20,000
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    follows = last.select("_last", F.lead("_range").over(order).alias("_to"), F.first("_range").over(upto).alias("_first"))
    follows = follows.select("_last", F.coalesce("_to", "_first").alias("_to"), F.col("_to").isNull().alias("_wraps"))
    own = F.struct(F.col("_range").alias("range"), F.lit(2).alias("turn"))
    more = F.struct(F.col("_to").alias("range"), F.when(F.col("_wraps"), 0).otherwise(1).alias("turn"))
    sent = placed.join(F.broadcast(follows), F.col("doc_id") == F.col("_last"), "left").withColumn("_copy", F.explode(F.when(F.col("_to").isNull(), F.array(own)).otherwise(F.array(own, more))))
    # Only texts travel; what is known of them is worked out where they meet.
    met = known(sent.select(*docs.columns, F.col("_copy.range").alias("_range"), F.col("_copy.turn").alias("_turn")).repartition("_range"))
    near = Window.partitionBy("_range").orderBy(F.col("_turn"), F.col("doc_id").asc_nulls_first(), F.col(columns[0]))
    out = met.select("*", *[F.lag(c).over(near).alias(f"next_{c}") for c in columns])
    return out.where(F.col("_turn") == 2).drop("_range", "_turn")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of the text with its second half replaced by the next text."""
    docs = only(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    known = lambda df: anchored(df, "text", "found").withColumn("hashes", F.array_distinct("found.hash")).withColumn("n_chars", F.length("text").cast("long"))
    pairs = with_next(docs, ["text", "hashes"], known)
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.col("next_text"), F.lit(1), half))
    both = anchored(pairs.withColumn("edited", edited).drop("text", "next_text"), "edited", "new")
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        printed(F.col("found")).alias("fingerprint"),
        printed(F.col("new")).alias("edited_fingerprint"),
        likeness(F.col("hashes"), F.array_distinct("new.hash")).alias("near_edited"),
        likeness(F.col("hashes"), F.col("next_hashes")).alias("near_next"),
        aligned(F.col("found"), F.col("new")).alias("aligned_edited"),
    )
