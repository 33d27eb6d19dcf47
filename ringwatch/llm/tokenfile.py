"""Token ids as flat unsigned integer files with 64-bit document offsets.

A corpus is a folder of shards in ascending document order. Shard ``k`` has three flat files:
``k.bin`` (ids, unsigned 16-bit, little-endian), ``k.doc`` (int64 document ids) and ``k.idx``
(uint64 offsets of its documents in the whole corpus, one more than documents). Shards are
written independently; their bases are prefix sums over one small row for each shard. Readers
memory-map a shard. A task that is run again writes the same file under the same name, renamed
into place when complete.

Nulls: a null text is empty (it has the end id only); a null doc_id sorts first and reads back as
null. Repeated rows are kept, in order of their texts' checksums; ties there are equal texts. Ids are written block by block, so a task holds
a few megabytes of text (or one text) and 16 bytes a document. An empty table gives shards without documents and no rows. Extra columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ringwatch.llm.common import only, saved, scratch, small_batches
from ringwatch.llm.words import merged

#: Documents a shard has at least, on average, once there are more shards than shuffle partitions.
ROWS = 100_000
_NULL = np.iinfo(np.int64).min


def _put(folder: str, name: str, chunks: Iterable) -> None:
    """Writes the chunks, one after another, to a file that gets its name when complete."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    part = f"{path}/.{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        for c in chunks:
            out.write(c)
    store.move(part, f"{path}/{name}")


def _map(folder: str, name: str, kind: str) -> np.ndarray:
    """The file's numbers: memory-mapped on a mounted store, read whole from any other."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(f"{folder}/{name}")
    if isinstance(store, fs.LocalFileSystem):
        with pa.memory_map(path) as source:
            return np.frombuffer(source.read_buffer(), kind)
    with store.open_input_file(path) as source:
        return np.frombuffer(source.read(), kind)


def write(docs: DataFrame, tokenizer: str, end_id: int, shards: int | None = None, folder: str | None = None) -> DataFrame:
    """Writes the shards; returns their manifest (folder, shard, documents, base of its ids)."""
    spark = docs.sparkSession
    small_batches(spark)
    folder = folder or scratch(spark, "tokens")
    shards = shards or max(24, int(spark.conf.get("spark.sql.shuffle.partitions")), docs.count() // ROWS)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from ringwatch.llm.bpe import Encoder

        shard, encoder = TaskContext.get().partitionId(), Encoder(tokenizer)
        docs_in, lengths = [], []

        def blocks() -> Iterator[np.ndarray]:
            for batch in merged(batches, "text"):
                ids, counts = encoder.encode(batch.column("text"))
                out = np.full(len(ids) + len(counts), end_id, "<u2")
                keep = np.ones(len(out), bool)
                keep[np.cumsum(counts + 1) - 1] = False
                out[keep] = ids
                docs_in.append(batch.column("doc_id").cast(pa.int64()).fill_null(_NULL).to_numpy(zero_copy_only=False).astype("<i8"))
                lengths.append(counts + 1)
                yield out

        _put(folder, f"{shard}.bin", blocks())
        sizes = np.concatenate(lengths) if lengths else np.zeros(0, np.int64)
        _put(folder, f"{shard}.doc", docs_in)
        _put(folder, f"{shard}.idx", [np.concatenate([[0], np.cumsum(sizes)]).astype("<u8")])
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "documents": [len(sizes)], "ids": [int(sizes.sum())]})

    ordered = only(docs, "doc_id", "text").repartitionByRange(shards, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.md5("text"))
    manifest = saved(ordered.mapInArrow(encode, "shard int, documents long, ids long"), "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one small row a shard
    return manifest.select(F.lit(folder).alias("folder"), "shard", "documents", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))


def rebase(manifest: DataFrame) -> DataFrame:
    """Gives every shard's offsets their place in the whole corpus; the manifest, once done."""

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                name = f"{row['shard']}.idx"
                offsets = _map(row["folder"], name, "<u8")
                _put(row["folder"], name, [offsets - offsets[0] + np.uint64(row["base"])])
            yield batch

    n = max(1, manifest.count())
    return saved(manifest.repartition(n, "shard").mapInArrow(move, manifest.schema), "rebased")


def read(manifest: DataFrame) -> DataFrame:
    """Documents of the shards: doc_id, start, n_tokens and the checksum of their ids as uint32."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, offsets, docs = (_map(row["folder"], f"{row['shard']}.{k}", t) for k, t in (("bin", "<u2"), ("idx", "<u8"), ("doc", "<i8")))
                for a in range(0, len(docs), 4096):
                    b = min(a + 4096, len(docs))
                    local = (offsets[a : b + 1] - offsets[0]).astype(np.int64)
                    wide = memoryview(np.ascontiguousarray(ids[local[0] : local[-1]], "<u4")).cast("B")
                    at = ((local - local[0]) * 4).tolist()
                    crc = [zlib.crc32(wide[x:y]) for x, y in zip(at, at[1:], strict=False)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(docs[a:b], pa.int64(), mask=docs[a:b] == _NULL),
                            pa.array(offsets[a:b].astype(np.int64)),
                            pa.array(np.diff(local)),
                            pa.array(crc, pa.int64()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    n = max(1, manifest.count())
    return manifest.repartition(n, "shard").mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long")
