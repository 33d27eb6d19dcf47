"""Violative-view measurement: view frame, strata, sampling, rater panels, estimates, curves."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ringwatch.operators.draws import inverted, with_distribution
from ringwatch.sources.platform import DAY_MS

#: Strata in their fixed order.
BANDS = ("lowest", "low", "middle", "highest", "no_score")
#: Risk weights, band cuts, days before a video has a score, critical value of a 95% interval.
W_PROVENANCE, W_DISCLOSURE, W_TEMPLATES, TEMPLATE_CAP = 0.60, 0.25, 0.15, 8
CUTS = (0.25, 0.50, 0.75)
SCORE_AFTER_DAYS, Z = 7, 1.959963984540054
PILOT_FLOOR, LEAST = 1e-4, 2


def uniform(seed: str, *keys: Column) -> Column:
    """A number in [0, 1) that depends on seed and keys only, however the data is partitioned."""
    text = F.concat_ws(":", F.lit(seed), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def risk(provenance: Column, disclosed: Column, templates: Column) -> Column:
    signal = F.when(provenance == "present", 0.0).when(provenance == "unknown", 0.5).otherwise(1.0)
    return signal * W_PROVENANCE + F.when(disclosed, 0.0).otherwise(1.0) * W_DISCLOSURE + F.least(F.lit(1.0), templates / TEMPLATE_CAP) * W_TEMPLATES


def band(score: Column) -> Column:
    return F.when(score.isNull(), "no_score").when(score < CUTS[0], "lowest").when(score < CUTS[1], "low").when(score < CUTS[2], "middle").otherwise("highest")


def video_bands(videos: DataFrame, comments: DataFrame, views: DataFrame) -> DataFrame:
    """Risk score and band of each video at the latest view; none for videos younger than a week then."""
    counts = comments.where("template_id is not null").join(videos.select("video_id", "channel_id"), "video_id").groupBy("channel_id").agg(F.count(F.lit(1)).alias("templated"))
    latest = F.broadcast(views.agg(F.max("ts_ms").alias("now_ms")))  # one row
    df = videos.join(counts, "channel_id", "left").crossJoin(latest)
    old = F.col("published_ms") <= F.col("now_ms") - SCORE_AFTER_DAYS * DAY_MS
    score = F.when(old, risk(F.col("provenance_signal"), F.col("synthetic_media_disclosed"), F.coalesce("templated", F.lit(0))))
    return df.select("video_id", score.alias("risk_score"), band(score).alias("band"))


def truth(labels: DataFrame, comments: DataFrame, scope: str = "baseline") -> DataFrame:
    """Distinct violative videos: without two comment-borne classes, with all classes, or also hosting such comments."""
    own = labels.where("entity_kind = 'video' and threat_class <> 'benign'")
    if scope != "expanded":
        own = own.where(~F.col("threat_class").isin("t01", "t06"))
    own = own.select(F.col("entity_id").alias("video_id"))
    if scope == "hosted":
        bad = labels.where("entity_kind = 'comment' and threat_class = 't01'").select(F.col("entity_id").alias("comment_id"))
        own = own.unionByName(comments.join(bad, "comment_id", "left_semi").select("video_id"))
    return own.distinct()


def view_frame(views: DataFrame, bands: DataFrame, violative: DataFrame) -> DataFrame:
    """Every view with the band and the truth of its video."""
    flagged = violative.select("video_id", F.lit(True).alias("bad"))
    return views.join(bands.select("video_id", "band"), "video_id").join(flagged, "video_id", "left").select(F.col("event_id").alias("view_id"), "video_id", "band", F.coalesce("bad", F.lit(False)).alias("violative"))


def strata(frame: DataFrame) -> DataFrame:
    """Size and true rate of each band, empty ones included."""
    names = frame.sparkSession.createDataFrame([(b,) for b in BANDS], "band string")
    counts = frame.groupBy("band").agg(F.count(F.lit(1)).alias("size"), F.count_if("violative").alias("hits"))
    out = names.join(counts, "band", "left").fillna(0, ["size", "hits"])
    return out.withColumn("rate", F.when(F.col("size") > 0, F.col("hits") / F.col("size")).otherwise(0.0))


def water_fill(weights: dict[str, float], sizes: dict[str, int], total: int) -> dict[str, int]:
    """Whole allocation in proportion to weights, between two (or the stratum's size) and its size.

    Strata whose share is out of bounds are set to the bound and the rest is shared anew; the
    parts lost in rounding go to the largest fractions.
    """
    names = [b for b in sizes if sizes[b] > 0]
    low = {b: min(LEAST, sizes[b]) for b in names}
    if not sum(low.values()) <= total <= sum(sizes[b] for b in names):
        raise ValueError(f"{total} draws don't fit strata of {sizes}")
    fixed: dict[str, float] = {}
    while True:
        free = [b for b in names if b not in fixed]
        left, mass = total - sum(fixed.values()), sum(weights[b] for b in free)
        share = {b: left * (weights[b] / mass if mass else 1 / len(free)) for b in free}
        under, over = [b for b in free if share[b] < low[b]], [b for b in free if share[b] > sizes[b]]
        short = sum(low[b] - share[b] for b in under) >= sum(share[b] - sizes[b] for b in over)
        if not under and not over:
            break
        fixed |= {b: low[b] for b in under} if short and under else {b: sizes[b] for b in over}
    exact = fixed | share
    out = {b: math.floor(exact[b] + 1e-9) for b in names}
    for b in sorted(names, key=lambda b: (-(exact[b] - out[b]), names.index(b)))[: total - sum(out.values())]:
        out[b] += 1
    return {b: out.get(b, 0) for b in sizes}


def proportional(sizes: dict[str, int], total: int) -> dict[str, int]:
    return water_fill({b: float(n) for b, n in sizes.items()}, sizes, total)


def neyman(sizes: dict[str, int], rates: dict[str, float], total: int) -> dict[str, int]:
    """Draws in proportion to size times standard deviation."""
    spread = lambda p: math.sqrt(max(p, PILOT_FLOOR) * (1 - max(p, PILOT_FLOOR)))
    return water_fill({b: n * spread(rates[b]) for b, n in sizes.items()}, sizes, total)


def draw(frame: DataFrame, allocation: dict[str, int], seed: str) -> DataFrame:
    """Exactly the allocated number of views of each band, those with the least hashes.

    Each hash slice keeps its own least first, so no band is ever gathered whole in one task.
    """
    sizes = F.broadcast(frame.sparkSession.createDataFrame(list(allocation.items()), "band string, n long"))  # one row a band
    marked = frame.join(sizes, "band").withColumn("_u", uniform(seed, F.col("view_id"))).withColumn("_part", F.pmod(F.xxhash64("view_id"), F.lit(64)))
    part = Window.partitionBy("band", "_part").orderBy("_u", "view_id")
    few = marked.withColumn("_r", F.row_number().over(part)).where("_r <= n")
    whole = Window.partitionBy("band").orderBy("_u", "view_id")  # at most 64 times the draws
    return few.withColumn("_r", F.row_number().over(whole)).where("_r <= n").select(*frame.columns)


def panel(sample: DataFrame, raters: list[tuple[str, float, float]], seed: str) -> DataFrame:
    """The majority's call on each view; raters are (id, sensitivity, specificity); an even tie is no call."""
    votes = [F.when(uniform(seed, F.col("view_id"), F.lit(r)) < F.when(F.col("violative"), sens).otherwise(1 - spec), 1).otherwise(0) for r, sens, spec in raters]
    total = sum(votes[1:], votes[0])
    return sample.withColumn("votes", total).withColumn("call", F.col("votes") * 2 > len(raters)).withColumn("split", (F.col("votes") > 0) & (F.col("votes") < len(raters)))


def stratified(calls: DataFrame, sizes: DataFrame) -> DataFrame:
    """Draws and calls of each band beside its size and share."""
    got = calls.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.count_if("call").alias("k"))
    whole = F.broadcast(sizes.agg(F.sum("size").alias("total")))
    return sizes.select("band", "size").join(got, "band", "left").fillna(0, ["n", "k"]).crossJoin(whole).withColumn("share", F.col("size") / F.col("total"))


def estimate(rows: DataFrame) -> DataFrame:
    """Point estimate, standard error with finite population correction, interval, validity.

    Bands are added in their fixed order, so that sums of doubles are the same in every run.
    """
    p = F.when(F.col("n") > 0, F.col("k") / F.col("n")).otherwise(0.0)
    v = F.when(F.col("n") > 1, F.col("share") * F.col("share") * (1 - F.col("n") / F.col("size")) * p * (1 - p) / (F.col("n") - 1)).otherwise(0.0)
    by = lambda x, b: F.coalesce(F.max(F.when(F.col("band") == b, x)), F.lit(0.0))
    add = lambda x: sum((by(x, b) for b in BANDS[1:]), by(x, BANDS[0]))
    counts = rows.agg(
        add(F.col("share") * p).alias("estimate"), F.sqrt(add(v)).alias("standard_error"), F.sum("n").alias("drawn"), F.sum("k").alias("successes"),
        F.count_if((F.col("size") > 0) & (F.col("n") == 0)).alias("unsampled"), F.count_if((F.col("n") > 0) & (F.col("n") < LEAST) & (F.col("size") >= LEAST)).alias("thin"),
        F.count_if((F.col("n") > 0) & (F.col("n") < F.col("size")) & ((F.col("k") == 0) | (F.col("k") == F.col("n")))).alias("degenerate"),
    )
    low, high = F.col("estimate") - Z * F.col("standard_error"), F.col("estimate") + Z * F.col("standard_error")
    ok = (F.col("unsampled") == 0) & (F.col("thin") == 0) & (F.col("degenerate") == 0) & (F.col("successes") >= 10) & (F.col("drawn") - F.col("successes") >= 10) & (low >= 0) & (high <= 1)
    return counts.select("estimate", "standard_error", F.greatest(F.lit(0.0), low).alias("low"), F.least(F.lit(1.0), high).alias("high"), "drawn", "successes", "unsampled", "thin", "degenerate", ok.alias("valid"))


def bootstrap(rows: DataFrame, replicates: int, seed: str) -> DataFrame:
    """95% percentile interval of the stratified bootstrap.

    Resampling a band's n calls with k successes gives Binomial(n, k/n) successes, drawn by inversion: a row for each replicate and band.
    """
    known = with_distribution(rows.where("n > 0").withColumn("p", F.col("k") / F.col("n")), "n", "p")
    draws = known.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    counts = draws.select("replicate", "band", "share", "n", inverted(uniform(seed, F.col("replicate"), F.col("band"))).alias("hits"))
    by = lambda b: F.coalesce(F.max(F.when(F.col("band") == b, F.col("share") * F.col("hits") / F.col("n"))), F.lit(0.0))
    means = counts.groupBy("replicate").agg(sum((by(b) for b in BANDS[1:]), by(BANDS[0])).alias("x"))
    return means.agg(F.expr("percentile(x, 0.025)").alias("low"), F.expr("percentile(x, 0.975)").alias("high"), F.count(F.lit(1)).alias("replicates"))


def width_ratio(rows: DataFrame) -> DataFrame:
    """How much wider the bootstrap interval is expected to be, which has no population correction."""
    p = F.when(F.col("n") > 0, F.col("k") / F.col("n")).otherwise(0.0)
    with_ = F.when(F.col("n") > 1, F.col("share") ** 2 * (1 - F.col("n") / F.col("size")) * p * (1 - p) / (F.col("n") - 1)).otherwise(0.0)
    without = F.when(F.col("n") > 0, F.col("share") ** 2 * p * (1 - p) / F.col("n")).otherwise(0.0)
    return rows.agg(F.sum(with_).alias("a"), F.sum(without).alias("b")).select(F.when(F.col("a") > 0, F.sqrt(F.col("b") / F.col("a"))).alias("ratio"))


def pilot_plan(frame: DataFrame, known: DataFrame, total: int, pilot: int, seed: str, raters: list[tuple[str, float, float]]) -> dict[str, int]:
    """Optimal allocation by the rates of a proportional pilot."""
    sizes = sizes_of(known)
    tried = stratified(panel(draw(frame, proportional(sizes, pilot), f"{seed}:pilot"), raters, f"{seed}:pilot-panel"), known)
    return neyman(sizes, {r["band"]: r["k"] / r["n"] if r["n"] else 0.0 for r in tried.collect()}, total)  # five rows


def sizes_of(known: DataFrame) -> dict[str, int]:
    found = {r["band"]: r["size"] for r in known.collect()}  # five rows
    return {b: found[b] for b in BANDS}


def measure(frame: DataFrame, total: int, seed: str, pilot: int = 0, raters: list[tuple[str, float, float]] | None = None) -> DataFrame:
    """Pilot, allocation, draw, panel and estimate in one; without a pilot the allocation is proportional."""
    raters = raters or [("expert", 1.0, 1.0)]
    known = strata(frame)
    plan = pilot_plan(frame, known, total, pilot, seed, raters) if pilot else proportional(sizes_of(known), total)
    return estimate(stratified(panel(draw(frame, plan, f"{seed}:sample"), raters, f"{seed}:panel"), known))


def estimates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """:func:`estimate` of every grid point at once; ``rows`` have the keys beside the bands' size, n, k and share."""
    p = F.when(F.col("n") > 0, F.col("k") / F.col("n")).otherwise(0.0)
    v = F.when(F.col("n") > 1, F.col("share") * F.col("share") * (1 - F.col("n") / F.col("size")) * p * (1 - p) / (F.col("n") - 1)).otherwise(0.0)
    by = lambda x, b: F.coalesce(F.max(F.when(F.col("band") == b, x)), F.lit(0.0))
    add = lambda x: sum((by(x, b) for b in BANDS[1:]), by(x, BANDS[0]))
    out = rows.groupBy(*keys).agg(add(F.col("share") * p).alias("estimate"), F.sqrt(add(v)).alias("standard_error"), F.sum("n").alias("drawn"))
    low, high = F.col("estimate") - Z * F.col("standard_error"), F.col("estimate") + Z * F.col("standard_error")
    return out.select(*keys, "estimate", "standard_error", F.greatest(F.lit(0.0), low).alias("low"), F.least(F.lit(1.0), high).alias("high"), "drawn")


def grid_draw(frame: DataFrame, plans: DataFrame, keys: list[str], seed: str) -> DataFrame:
    """The views of every grid point: ``plans`` have the keys, band and n. A view's place in its band does not depend on the grid, so it is worked out once.

    Hash slices keep their own least first, so no band is ever gathered whole in one task.
    """
    most = F.broadcast(plans.groupBy("band").agg(F.max("n").alias("_most")))  # one row a band
    marked = frame.join(most, "band").withColumn("_u", uniform(seed, F.col("view_id"))).withColumn("_part", F.pmod(F.xxhash64("view_id"), F.lit(64)))
    few = marked.withColumn("_r", F.row_number().over(Window.partitionBy("band", "_part").orderBy("_u", "view_id"))).where("_r <= _most")
    whole = Window.partitionBy("band").orderBy("_u", "view_id")  # at most 64 times the draws
    placed = few.withColumn("_r", F.row_number().over(whole)).where("_r <= _most").select("view_id", "band", "violative", "_r")
    return placed.join(F.broadcast(plans), "band").where("_r <= n").drop("_r", "n")  # a few rows a grid point


def grid_rows(calls: DataFrame, known: DataFrame, grid: DataFrame, keys: list[str]) -> DataFrame:
    """Draws and calls of each band of each grid point beside the band's size and share."""
    got = calls.groupBy(*keys, "band").agg(F.count(F.lit(1)).alias("n"), F.count_if("call").alias("k"))
    share = known.select("band", "size", (F.col("size") / F.sum("size").over(Window.partitionBy(F.lit(0)))).alias("share"))  # five rows
    return grid.crossJoin(F.broadcast(share)).join(got, [*keys, "band"], "left").fillna(0, ["n", "k"])  # five rows a grid point


def curve_sizes(frame: DataFrame, known: DataFrame, sizes: list[int], seed: str) -> DataFrame:
    """Half width of the interval for each number of draws, of one proportional order of the views, in one plan."""
    spark, held = frame.sparkSession, sizes_of(known)
    plans = spark.createDataFrame([(n, b, k) for n in sizes for b, k in proportional(held, n).items()], "draws int, band string, n long")
    calls = grid_draw(frame, plans, ["draws"], seed).withColumn("call", F.col("violative"))
    rows = grid_rows(calls, known, plans.select("draws").distinct(), ["draws"])
    return estimates(rows, ["draws"]).select("draws", ((F.col("high") - F.col("low")) / 2).alias("half_width"), "estimate", "drawn")


def curve_raters(frame: DataFrame, known: DataFrame, total: int, specificities: list[float], panels: list[int], seed: str) -> DataFrame:
    """Bias of the estimate for each rater quality and panel size, on the same draw: a row a view, quality and panel."""
    spark = frame.sparkSession
    plans = spark.createDataFrame(list(proportional(sizes_of(known), total).items()), "band string, n long")
    grid = spark.createDataFrame([(s, n) for s in specificities for n in panels], "specificity double, panel int")
    sample = grid_draw(frame, plans, [], seed).crossJoin(F.broadcast(grid))  # a stated grid
    right = F.when(F.col("violative"), F.col("specificity")).otherwise(1 - F.col("specificity"))
    votes = F.size(F.filter(F.sequence(F.lit(1), F.col("panel")), lambda r: uniform(f"{seed}:panel", F.col("view_id"), F.col("specificity").cast("decimal(6,4)"), r) < right))
    calls = sample.withColumn("call", votes * 2 > F.col("panel"))
    keys = ["specificity", "panel"]
    found = estimates(grid_rows(calls, known, grid, keys), keys)
    real = F.broadcast(known.agg((F.sum("hits") / F.sum("size")).alias("truth")))  # one row
    out = found.crossJoin(real)
    return out.select(*keys, "estimate", (F.col("estimate") - F.col("truth")).alias("bias"), ((F.col("truth") >= F.col("low")) & (F.col("truth") <= F.col("high"))).alias("covered"))


def curve_scopes(frames: dict[str, DataFrame], shares: int, seed: str) -> DataFrame:
    """Estimates of each scope's frame from its own proportional sample of one in ``shares``, in one plan."""
    every = reduce(DataFrame.unionByName, [f.withColumn("label", F.lit(k)) for k, f in frames.items()])
    sizes = every.groupBy("label", "band").agg(F.count(F.lit(1)).alias("size"))
    order = Window.partitionBy("label", "band", "_part").orderBy("_u", "view_id")
    marked = every.join(F.broadcast(sizes), ["label", "band"]).withColumn("_most", F.ceil(F.col("size") / shares))  # a row a scope and band
    marked = marked.withColumn("_u", uniform(seed, F.col("view_id"))).withColumn("_part", F.pmod(F.xxhash64("view_id"), F.lit(64)))
    few = marked.withColumn("_r", F.row_number().over(order)).where("_r <= _most")
    whole = Window.partitionBy("label", "band").orderBy("_u", "view_id")  # at most 64 times the draws
    got = few.withColumn("_r", F.row_number().over(whole)).where("_r <= _most").groupBy("label", "band").agg(F.count(F.lit(1)).alias("n"), F.count_if("violative").alias("k"))
    share = sizes.withColumn("share", F.col("size") / F.sum("size").over(Window.partitionBy("label")))  # five rows a scope
    return estimates(share.join(got, ["label", "band"]), ["label"]).select("label", "estimate", "low", "high", "drawn")


def stratum_lines(rows: DataFrame) -> DataFrame:
    """The stratum table as text, a line a band in their order: name, size, draws, calls, share and rate."""
    p = F.when(F.col("n") > 0, F.col("k") / F.col("n")).otherwise(0.0)
    place = F.array_position(F.array(*map(F.lit, BANDS)), F.col("band"))
    line = F.format_string("%-10s %10d %8d %6d  %.4f  %.4f", "band", "size", "n", "k", F.round(F.col("share"), 4), F.round(p, 4))
    return rows.select(place.alias("place"), line.alias("line"))


def minutes(steps: DataFrame, cases: int, variation: float = 0.5) -> DataFrame:
    """One-way sensitivity of the minutes a workflow saves: each assisted time up and down by a share."""
    whole = F.broadcast(steps.agg(F.sum(F.col("baseline") - F.col("assisted")).alias("delta")))  # one row
    rest = F.col("delta") - (F.col("baseline") - F.col("assisted"))
    return steps.crossJoin(whole).select(
        "step", ((rest + F.col("baseline") - F.col("assisted") * (1 + variation)) * cases).alias("low_delta"), ((rest + F.col("baseline") - F.col("assisted") * (1 - variation)) * cases).alias("high_delta"),
        F.col("baseline").alias("break_even"), (F.col("delta") * cases).alias("delta"),
    )
