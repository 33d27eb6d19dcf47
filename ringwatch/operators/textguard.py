"""Text firewall: pattern scan, span merge, redaction and fencing of untrusted text."""

from __future__ import annotations

import hashlib
import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The reviewed pattern families, in their order; matched without regard to case.
PATTERNS = {
    "instruction_override": (
        r"(?:ignore|disregard|forget|override|bypass)\s+(?:all\s+|any\s+|the\s+|your\s+)*"
        r"(?:previous|prior|above|earlier|system|initial)?\s*"
        r"(?:instruction|instructions|prompt|prompts|rule|rules|direction|directions|guideline|guidelines)"
    ),
    "role_marker": (
        r"(?:^|\n)\s*(?:system|assistant|user|developer)\s*:"
        r"|<\|(?:im_start|im_end|system|endoftext)\|>"
        r"|\[/?INST\]"
        r"|(?:^|\n)#{1,6}\s*(?:instruction|system prompt)"
    ),
    "tool_call_mimicry": (
        r"</?(?:function_calls|invoke|tool_use|tool_call|antml:\w+)\b"
        r"|\btool_call\s*[:=]"
        r"|\"(?:tool|tool_name|function|function_call)\"\s*:"
    ),
    "delimiter_escape": (
        r"-{3,}\s*(?:BEGIN|END)\b"
        r"|</?(?:data|document|case|content|context)\s*>"
        r"|```"
        r'|"""'
    ),
    "exfiltration": (
        r"(?:reveal|print|repeat|show|output|dump|leak)\s+(?:me\s+|us\s+|back\s+)*"
        r"(?:your|the|all)?\s*"
        r"(?:system\s+prompt|instructions|prompt|configuration|api[_\s-]?key|credentials|secret)"
        r"|(?:send|post|upload|exfiltrate|forward)\s+(?:\S+\s+){0,6}?(?:to\s+)?https?://"
    ),
    "authority_claim": (
        r"(?:you\s+are\s+now|from\s+now\s+on|act\s+as|pretend\s+to\s+be|"
        r"new\s+instructions?|updated\s+instructions?|developer\s+mode|admin\s+override)"
        r"|(?:this\s+is\s+)?(?:an?\s+)?(?:official|authorized|approved)\s+"
        r"(?:request|instruction|override)\s+from"
    ),
    "encoded_payload": (
        r"(?:base64|rot13|hex)\s*(?:decode|encoded|:)"
        r"|data:text/[a-z]+;base64,"
    ),
}
#: Line separators other than the line feed, which must not split a fenced line.
BREAKS = "\x0b\x0c\x1c\x1d\x1e\x85  "


#: What a text must hold for a family to match at all: any of the alternatives, of each alternative some literal of every group. Texts are folded first.
NEEDED = {
    "instruction_override": [(("ignore", "disregard", "forget", "override", "bypass"), ("instruction", "prompt", "rule", "direction", "guideline"))],
    "role_marker": [((":",), ("system", "assistant", "user", "developer")), (("<|",), ("|>",)), (("inst]",),), (("#",), ("instruction", "system prompt"))],
    "tool_call_mimicry": [(("<",), ("function_calls", "invoke", "tool_use", "tool_call", "antml:")), (("tool_call",),), (('"',), ("tool", "function"), (":",))],
    "delimiter_escape": [(("---",), ("begin", "end")), (("<",), ("data", "document", "case", "content", "context"), (">",)), (("```", '"""'),)],
    "exfiltration": [
        (("reveal", "print", "repeat", "show", "output", "dump", "leak"), ("prompt", "instructions", "configuration", "api", "credentials", "secret")),
        (("://",), ("send", "post", "upload", "exfiltrate", "forward")),
    ],
    "authority_claim": [
        (("you",), ("are",), ("now",)), (("from",), ("now",), ("on",)), (("act",), ("as",)), (("pretend",),), (("new", "updated"), ("instruction",)), (("developer",), ("mode",)), (("admin",), ("override",)),
        (("official", "authorized", "approved"), ("request", "instruction", "override"), ("from",)),
    ],
    "encoded_payload": [(("base64", "rot13", "hex"), ("decode", "encoded", ":")), (("data:text/",),)],
}


def _any(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts)


def screened(records: DataFrame) -> DataFrame:
    """``records`` with ``_may``, an array that tells for each family whether its pattern can match.

    Case is folded as the patterns' matching does (long s, dotless i and the Kelvin sign included), so no match is lost.
    """
    df = records.withColumn("_folded", F.translate(F.lower("text"), "\u017f\u0131\u0307", "si"))
    has = lambda literal: F.col("_folded").contains(literal)
    may = [_any([reduce(lambda a, b: a & b, [_any([has(x) for x in group]) for group in alternative]) for alternative in NEEDED[k]]) for k in PATTERNS]
    return df.withColumn("_may", F.array(*may)).drop("_folded")


def _pattern(family: str) -> Column:
    return F.lit(f"(?iuU){PATTERNS[family]}")


def counts(records: DataFrame) -> DataFrame:
    """Matches of each family in each record, in JVM expressions; a pattern runs only over texts that hold its literals."""
    each = [F.when(F.get("_may", i), F.size(F.regexp_extract_all("text", _pattern(k), F.lit(0)))).otherwise(0).cast("long").alias(k) for i, k in enumerate(PATTERNS)]
    return screened(records).select("record_id", *each)


def scan(records: DataFrame) -> DataFrame:
    """Every match: record, family, offset and length in characters, and its text.

    What stands between the matches tells their offsets: a match begins after all pieces and matches before it. Only records with a match reach the window
    that adds these lengths up. Rows are numbered before they are filtered: a filter may not pass that column, or it would fold the text once a literal.
    """
    df = screened(records.select("record_id", "text")).withColumn("_row", F.monotonically_increasing_id()).where(F.array_contains("_may", True))
    found = []
    for i, k in enumerate(PATTERNS):
        hits = F.when(F.get("_may", i), F.regexp_extract_all("text", _pattern(k), F.lit(0)))
        gaps = F.transform(F.split("text", f"(?iuU){PATTERNS[k]}", -1), lambda x: F.length(x))
        found.append(F.when(F.size(hits) > 0, F.struct(F.lit(k).alias("pattern_id"), hits.alias("hits"), gaps.alias("gaps"))))
    each = df.select("_row", "record_id", F.explode(F.array_compact(F.array(*found))).alias("f"))
    cells = F.transform("f.hits", lambda x, i: F.struct(F.get(F.col("f.gaps"), i).alias("gap"), x.alias("matched_text")))
    rows = each.select("_row", "record_id", "f.pattern_id", F.posexplode(cells).alias("_i", "m")).withColumn("length", F.length("m.matched_text"))
    order = Window.partitionBy("_row", "pattern_id").orderBy("_i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = F.sum(F.col("m.gap") + F.col("length")).over(order)
    return rows.select("record_id", "pattern_id", (upto - F.col("length")).cast("int").alias("offset"), "length", F.col("m.matched_text").alias("matched_text"))


def merged(signals: DataFrame) -> DataFrame:
    """Spans that touch or overlap become one, which keeps the first family: gaps and islands."""
    order = Window.partitionBy("record_id").orderBy("offset", F.desc("length"), "pattern_id")
    reach = F.max(F.col("offset") + F.col("length")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    df = signals.withColumn("_new", F.when(F.col("offset") <= reach, 0).otherwise(1)).withColumn("_span", F.sum("_new").over(order))
    df = df.withColumn("_first", F.row_number().over(order))
    return df.groupBy("record_id", "_span").agg(F.min("offset").alias("start"), F.max(F.col("offset") + F.col("length")).alias("end"), F.min_by("pattern_id", "_first").alias("pattern_id")).drop("_span")


def marker(pattern: str, nonce: str) -> str:
    return f"[redacted:{pattern}:{nonce}]"


def redact(records: DataFrame, spans: DataFrame, nonce: str) -> DataFrame:
    """Records with every merged span replaced by a marker that names its family.

    Spans of a record are collected (they are disjoint parts of its text) and cut out from the left.
    """
    cuts = spans.groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "pattern_id"))).alias("cuts"))
    df = records.join(cuts, "record_id", "left")
    ends = F.concat(F.array(F.lit(0)), F.transform("cuts", lambda c: c["end"]))
    kept = F.transform("cuts", lambda c, i: F.concat(F.substring(F.col("text"), F.get(ends, i) + 1, c["start"] - F.get(ends, i)), F.lit("[redacted:"), c["pattern_id"], F.lit(f":{nonce}]")))
    tail = F.substring(F.col("text"), F.element_at(ends, -1) + 1, F.length("text"))
    return df.withColumn("text", F.when(F.col("cuts").isNull(), F.col("text")).otherwise(F.concat(F.array_join(kept, ""), tail))).select(*records.columns)


def duplicates(records: DataFrame) -> DataFrame:
    """Record ids that occur more than once; wrapping refuses them."""
    return records.groupBy("record_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def body(records: DataFrame) -> DataFrame:
    """One JSON object a record with keys in order, other line separators escaped."""
    line = F.to_json(F.struct("record_id", "source", "text"))
    for c in BREAKS:
        line = F.replace(line, F.lit(c), F.lit(f"\\u{ord(c):04x}"))
    return records.select("record_id", line.alias("line"))


def nonce(text: str, most: int = 64) -> str:
    """The first derived nonce that the text does not contain."""
    for i in range(most):
        value = hashlib.sha256(f"ringwatch.fence\x1f{i}\x1f{text}".encode()).hexdigest()[:32]
        if value not in text:
            return value
    raise ValueError("no free nonce")


def fence(records: DataFrame) -> str:
    """The fenced block of a few records (a reviewer's page: at most a queue's worth)."""
    if not duplicates(records).isEmpty():
        raise ValueError("duplicate record ids")
    text = "\n".join(r["line"] for r in body(records).orderBy("record_id").collect())
    mark = nonce(text)
    return f"<<<{mark}\n{text}\n{mark}>>>"


def parse_fence(block: str) -> list[dict]:
    """The records of a fenced block."""
    first, *lines, last = block.split("\n")
    if not first.startswith("<<<") or last != f"{first[3:]}>>>":
        raise ValueError("not a fence")
    return [json.loads(x) for x in lines if x]
