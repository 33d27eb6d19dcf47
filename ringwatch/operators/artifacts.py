"""What artifacts need to be the same bytes everywhere: rounding, canonical JSON and its digests, curve files."""

from __future__ import annotations

import csv
import io
import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringwatch.operators.ledger import SEPARATOR

#: Splits a double of 53 bits in two halves whose products are exact.
_SPLIT = 134217729.0
#: Doubles from here on are whole numbers.
_WHOLE = 4503599627370496.0


def rounded(x: Column, places: int) -> Column:
    """``x`` rounded to decimal places by its exact binary value, ties to even: what Python's ``round`` gives.

    The fraction times 10 ** places is taken as an exact sum of two doubles (a product and its error), so a tie is told from a near tie. The
    result is put together as a decimal and read back as the nearest double. Infinite, NaN and null values stay.
    """
    scale, whole, part = float(10**places), "whole", "part"
    s_high = scale * _SPLIT - (scale * _SPLIT - scale)
    s_low = scale - s_high

    def split(size: Column) -> Column:
        low = F.floor(F.when(size < _WHOLE, size).otherwise(0.0))
        return F.struct(low.alias(whole), (size - low).alias(part))

    def multiplied(v: Column) -> Column:
        high = v[part] * _SPLIT - (v[part] * _SPLIT - v[part])
        return F.struct(v[whole], v[part], (v[part] * scale).alias("product"), high.alias("high"), (v[part] - high).alias("low"))

    def exact(v: Column) -> Column:
        error = ((v["high"] * s_high - v["product"]) + v["high"] * s_low + v["low"] * s_high) + v["low"] * s_low
        return F.struct(v[whole], v["product"], error.alias("error"), F.floor(v["product"]).alias("floor"))

    def near(v: Column) -> Column:
        rest = v["product"] - v["floor"]
        odd = (v["floor"] if places else v["floor"] + v[whole]) % 2 == 1
        up = (rest > 0.5) | ((rest == 0.5) & ((v["error"] > 0) | ((v["error"] == 0) & odd)))
        digits = (v["floor"] + F.when(up, 1).otherwise(0)).cast(f"decimal({places + 2},0)") / F.lit(10**places).cast(f"decimal({places + 1},0)")
        return (v[whole].cast("decimal(16,0)") + digits.cast(f"decimal({places + 2},{places})")).cast("double")

    def then(v: Column, f: Callable[[Column], Column]) -> Column:
        return F.get(F.transform(F.array(v), f), 0)  # a name for v, so that the expression does not grow with every use of it

    size = F.abs(x)
    back = then(then(then(then(size, split), multiplied), exact), near)
    plain = x.isNull() | F.isnan(x) | (size >= _WHOLE)
    return F.when(plain, x).otherwise(F.when(x < 0, -back).otherwise(back))


def canonical_json(text: Column) -> Column:
    """A JSON text with the keys of every object in order and no white space; null where it is no JSON."""
    return F.to_json(F.try_parse_json(text))


def json_digest(text: Column) -> Column:
    """SHA-256 of the canonical form."""
    return F.sha2(canonical_json(text), 256)


def typed_digest(domain: str, fields: dict[str, Column]) -> Column:
    """Digest of named values: the domain, then ``name=type:value`` in order of names; a null value is the type alone."""

    def cell(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}="), F.typeof(value), F.lit(":"), F.coalesce(value.cast("string"), F.lit("")))

    return F.sha2(F.concat_ws(SEPARATOR, F.lit(domain), *[cell(n, fields[n]) for n in sorted(fields)]), 256)


def attributes(fields: dict[str, Column]) -> Column:
    """A map of the values as text, without the nulls."""
    entries = F.array_compact(F.array(*[F.when(v.isNotNull(), F.struct(F.lit(n).alias("key"), v.cast("string").alias("value"))) for n, v in fields.items()]))
    return F.map_from_entries(entries)


def curve_files(curve: DataFrame, x: str, label: str | None = None) -> tuple[str, str]:
    """A curve (a few points) as JSON and CSV text: points in order of x, values rounded to ten places, line feeds only."""
    names = [c for c in curve.columns if c not in (x, label)]
    rows = curve.orderBy(*([label] if label else []), x).collect()
    near = lambda v: round(v, 10) if isinstance(v, float) and math.isfinite(v) else v
    points = [{"x": near(r[x]), **({"label": r[label]} if label else {}), "values": {n: near(r[n]) for n in names}} for r in rows]
    out = io.StringIO()
    table = csv.writer(out, lineterminator="\n")
    table.writerow([x, *([label] if label else []), *names])
    for p in points:
        table.writerow([p["x"], *([p["label"]] if label else []), *p["values"].values()])
    return json.dumps({"points": points}, sort_keys=True, indent=2) + "\n", out.getvalue()
