"""A data source that recomputes digests while it reads: ``spark.read.format("sealed_set")``.

A sealed set is a folder with ``manifest.json`` and the files it names. The manifest lists each file's SHA-256 and number of records, and the digest of the
whole: SHA-256 over ``name=digest`` in order of names. Files hold one JSON object a line. Each file is a partition, hashed as it is parsed; a file that does not
match, or a manifest that does not match itself, ends the read with an error, so no record of a forged set is ever the result of a query.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ringwatch.operators.ledger import SEPARATOR


class SealBroken(ValueError):
    """What is read is not what was sealed."""


def _open(path: str):
    from pyarrow import fs

    store, inside = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    return store.open_input_stream(inside)


def whole_digest(files: dict[str, dict]) -> str:
    return hashlib.sha256(SEPARATOR.join(f"{n}={files[n]['sha256']}" for n in sorted(files)).encode()).hexdigest()


@dataclass
class _File(InputPartition):
    path: str
    name: str
    sha256: str
    records: int

    def __init__(self, path: str, name: str, sha256: str, records: int):
        super().__init__(name)
        self.path, self.name, self.sha256, self.records = path, name, sha256, records


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, path: str, expected: str | None):
        self.schema, self.path, self.expected = schema, path.rstrip("/"), expected

    def partitions(self) -> list[_File]:
        with _open(f"{self.path}/manifest.json") as f:
            manifest = json.loads(f.read())
        digest = whole_digest(manifest["files"])
        if digest != manifest["digest"] or self.expected not in (None, digest):
            raise SealBroken(f"the manifest of {self.path} has another digest than was sealed")
        return [_File(f"{self.path}/{n}", n, x["sha256"], x["records"]) for n, x in sorted(manifest["files"].items())]

    def read(self, partition: _File) -> Iterator[tuple]:
        seen, n, rest = hashlib.sha256(), 0, b""
        with _open(partition.path) as f:
            while chunk := f.read(1 << 20):
                seen.update(chunk)
                *lines, rest = (rest + chunk).split(b"\n")
                for line in lines:
                    n += 1
                    record = json.loads(line)
                    yield tuple(record.get(c) for c in self.schema.names)
        if rest or seen.hexdigest() != partition.sha256 or n != partition.records:
            raise SealBroken(f"{partition.name} is not the file that was sealed")


class SealedSet(DataSource):
    """Options: ``path``, and ``digest`` to ask for one particular set."""

    @classmethod
    def name(cls) -> str:
        return "sealed_set"

    def schema(self) -> str:
        raise ValueError("a sealed set is read with a schema")

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(schema, self.options["path"], self.options.get("digest"))


def seal(df: DataFrame, folder: str, parts: int = 1) -> str:
    """Writes ``df`` as a sealed set of ``parts`` files in a folder that all executors share; returns its digest. A file is written by the task that hashes it."""
    from pyarrow import fs

    def write(batches) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        store, inside = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        store.create_dir(inside, recursive=True)
        name, seen, n = f"part-{TaskContext.get().partitionId():05d}.jsonl", hashlib.sha256(), 0
        with store.open_output_stream(f"{inside}/{name}") as out:
            for batch in batches:
                for line in batch.column(0).to_pylist():
                    data = line.encode() + b"\n"
                    seen.update(data)
                    out.write(data)
                    n += 1
        yield pa.RecordBatch.from_pydict({"name": [name], "sha256": [seen.hexdigest()], "records": [n]})

    lines = df.selectExpr("to_json(struct(*), map('ignoreNullFields', 'false')) line").repartition(parts)
    files = {r["name"]: {"sha256": r["sha256"], "records": r["records"]} for r in lines.mapInArrow(write, "name string, sha256 string, records long").collect()}  # a row a file
    store, inside = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
    digest = whole_digest(files)
    with store.open_output_stream(f"{inside}/manifest.json") as out:
        out.write(json.dumps({"digest": digest, "files": files}, sort_keys=True, indent=1).encode())
    return digest
