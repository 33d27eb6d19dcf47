"""Sources and sinks: Parquet per scope, CSV, JSON lines, GraphML, digests of files and datasets."""

from __future__ import annotations

import json
from collections.abc import Mapping
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ringwatch.operators.graph import Pack
from ringwatch.sources.platform import SEALED_COLUMNS


def export(views: Mapping[str, DataFrame], folder: str) -> None:
    """One Parquet table a view; a view with a sealed column is refused before anything is written."""
    leaks = {n: sorted(set(df.columns) & SEALED_COLUMNS) for n, df in views.items()}
    if bad := {n: c for n, c in leaks.items() if c}:
        raise ValueError(f"sealed columns in {bad}")
    for name, df in views.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def leaked(spark: SparkSession, path: str) -> list[str]:
    """Sealed columns of an exported table; reads its schema only."""
    return sorted(set(spark.read.parquet(path).columns) & SEALED_COLUMNS)


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """CSV files with a header and texts over several lines, each row tagged with its file."""
    rows = spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"')
    return rows.withColumn("file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))


def write_jsonl(df: DataFrame, path: str) -> None:
    """One object a line with sorted keys."""
    df.select(*sorted(df.columns)).write.mode("overwrite").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines; blank lines are skipped, a malformed one is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def dataset_identity(df: DataFrame) -> DataFrame:
    """A digest of a table's rows whatever their order or files: count, and two folds of row hashes."""
    names = sorted(df.columns)
    h = F.xxhash64(*[F.col(c) for c in names])
    folds = df.select(h.alias("h")).agg(F.count(F.lit(1)).alias("n"), F.bit_xor("h").alias("x"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s"))
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("n", "x", "s")]
    return folds.select(F.sha2(F.concat_ws("\x1f", F.lit(",".join(names)), *cells), 256).alias("identity"))


def graphml(pack: Pack) -> str:
    """The pack as a directed GraphML document. A pack is bounded by hops times rows a hop."""
    root = ElementTree.Element("graphml", xmlns="http://graphml.graphdrawing.org/xmlns")
    for key, of in (("kind", "node"), ("hop_index", "all"), ("relation", "edge")):
        ElementTree.SubElement(root, "key", id=key, attrib={"for": of, "attr.name": key, "attr.type": "string"})
    graph = ElementTree.SubElement(root, "graph", edgedefault="directed")

    def add(tag: str, attrib: dict, data: dict) -> None:
        e = ElementTree.SubElement(graph, tag, attrib)
        for k, v in sorted(data.items()):
            ElementTree.SubElement(e, "data", key=k).text = str(v)

    for r in pack.nodes.orderBy("hop_index", "node_id").collect():
        add("node", {"id": r["node_id"]}, {"kind": r["kind"], "hop_index": r["hop_index"]})
    for r in pack.edges.orderBy("hop_index", "edge_id").collect():
        add("edge", {"id": r["edge_id"], "source": r["source_id"], "target": r["target_id"]}, {"relation": r["relation"], "hop_index": r["hop_index"]})
    return ElementTree.tostring(root, encoding="unicode")


def pack_json(pack: Pack) -> str:
    """The pack as JSON with sorted keys."""
    rows = lambda df, *by: [r.asDict() for r in df.orderBy(*by).collect()]
    parts = {"nodes": rows(pack.nodes, "hop_index", "node_id"), "edges": rows(pack.edges, "hop_index", "edge_id"), "events": rows(pack.events, "hop_index", "event_id"), "provenance": rows(pack.provenance, "hop_index")}
    return json.dumps(parts, sort_keys=True, ensure_ascii=False)


def read_pack(spark: SparkSession, text: str) -> Pack:
    """A pack from its JSON; records are checked by :func:`ringwatch.operators.graph.violations`."""
    from ringwatch.operators.graph import EDGE, EVENT, NODE, PROVENANCE

    data = json.loads(text)
    make = lambda k, schema: spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in data[k]], schema)
    return Pack(make("nodes", NODE), make("edges", EDGE), make("events", EVENT), make("provenance", PROVENANCE))
