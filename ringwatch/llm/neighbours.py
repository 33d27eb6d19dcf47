"""Nearest neighbours by inner product: cells, randomly rotated one-bit codes, bounds, exact rerank.

Vectors are dealt to cells by the nearest of at most ``CELLS`` centres, which are learnt from a bounded sample (``SAMPLE`` vectors of the
least hashes). A query visits its best cell first and then every cell that may hold a better vector: no product there exceeds that with the
centre plus the query's length times the cell's radius. Cells below the query's k-th best so far are skipped, and lose nothing by it; where vectors
have no clusters few cells are, and codes alone spare the work. In a cell each residual (vector less centre) is scaled to length one and turned by a random matrix with orthonormal rows into
``BITS`` or more coordinates (more than its own, which narrows the error); its code is the packed signs. With ``o`` the unit
residual and ``c`` its code's unit vector, the inner product with a query ``q`` is estimated as ``<c, q> / <c, o>`` and errs by at most
``epsilon * sqrt((1 - <c, o>^2) / <c, o>^2) * |q| / sqrt(bits - 1)`` except with a probability that falls off
exponentially in epsilon squared. Both scalars are kept with the code. The rotated query is rounded to ``LEVELS`` bits a
coordinate, so that ``<c, q>`` is counted from packed bits alone (one population count for each bit of a coordinate); the rounding widens the bound.

Cells are stored in blocks of at most about ``block`` codes (fewer for long vectors, ``BLOCK_BYTES``) with their vectors beside them, and their
queries in blocks too; a block of codes meets a block of queries in one row, dealt by cell and both blocks, so a cell that holds a third of all rows is
many rows. There a query's candidates are those whose upper bound reaches its k-th best lower bound; only for those is the exact product
taken, in double precision and in the order of the components. A block gives at most k rows a query, which lose none of its k nearest.
A query meets its first cell before the others; its k-th best product there is a floor that candidates in other cells must reach, too.
The nearest over all blocks follow.

Nulls: vectors that are null, empty, zero, of another length than most, or that hold a null or non-finite
component take no part, as do null ids. Repeated rows with one id count once, with the least of their vectors. Ties go to the smaller id. With
fewer candidates than k all are returned. Long vectors only make rows wider. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ringwatch.llm.common import salt, saved, small_batches

BITS, LEVELS = 256, 6
#: Vectors that centres are learnt from, vectors a cell has on average, cells at most.
SAMPLE, CELL, CELLS = 20_000, 2048, 16_384
#: Vectors and queries of a block take about this much, in double precision.
BLOCK_BYTES = 4 << 20


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the vectors that take part, in double precision."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    df = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    df = df.where(~bad & F.exists("v", lambda x: x != 0.0)).groupBy("vec_id").agg(F.min("v").alias("v"))
    usual = df.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).select("dim")
    return df.join(F.broadcast(usual), F.size("v") == F.col("dim"), "left_semi")


def rotation(dim: int, bits: int, seed: int) -> np.ndarray:
    """A random matrix with orthonormal rows, the same on every executor."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, dim)))
    return (q * np.sign(np.diag(r))).T


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def centres(sample: np.ndarray, count: int, seed: int) -> np.ndarray:
    """Centres of cells by a few rounds of k-means over the sample."""
    rng = np.random.default_rng(seed)
    middle = sample[rng.choice(len(sample), min(count, len(sample)), replace=False)]
    for _ in range(6):
        near = np.concatenate([(x @ middle.T - (middle * middle).sum(axis=1) / 2).argmax(axis=1) for x in np.array_split(sample, max(1, len(sample) // 4096))])
        order = np.argsort(near, kind="stable")
        held = np.unique(near[order], return_index=True)
        middle[held[0]] = np.add.reduceat(sample[order], held[1]) / np.diff(np.append(held[1], len(sample)))[:, None]
    return middle


def assigned(rows: DataFrame, middle: np.ndarray) -> DataFrame:
    """Adds the cell of every vector, and how far the vector is from its centre."""

    def cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = (middle * middle).sum(axis=1) / 2
        for batch in batches:
            if batch.num_rows:
                v = _matrix(batch.column("v"))
                near = (v @ middle.T - size).argmax(axis=1)
                away = np.sqrt(((v - middle[near]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(near, pa.int32()), pa.array(away)], names=["vec_id", "v", "cell", "away"])

    return rows.mapInArrow(cell, "vec_id long, v array<double>, cell int, away double")


def radii(placed: DataFrame, count: int) -> np.ndarray:
    """Each cell's largest distance from its centre (one row a cell, of which there are at most CELLS); minus infinity for empty cells."""
    out = np.full(count, -np.inf)
    for row in placed.groupBy("cell").agg(F.max("away").alias("away")).collect():
        out[row["cell"]] = row["away"]
    return out


def visits(asked: DataFrame, middle: np.ndarray, radius: np.ndarray, first: bool) -> DataFrame:
    """(cell, query_id, v, floor): each query's first cell, or else all other cells where a product may reach its floor.

    The first cell is the one, of those with vectors, whose centre has the largest product with the query.
    """
    held = np.isfinite(radius)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v, floor = _matrix(batch.column("v")), batch.column("floor").to_numpy(zero_copy_only=False)
                got = np.where(held, v @ middle.T, -np.inf)
                best = np.arange(len(middle)) == got.argmax(axis=1)[:, None]
                reach = np.sqrt((v * v).sum(axis=1))[:, None] * np.where(held, radius, 0.0)
                # A little more than the bound, for the rounding of both sides.
                may = held & (got + reach + 1e-9 * (np.abs(got) + reach) >= floor[:, None])
                query, at = np.nonzero(best if first else may & ~best)
                for a in range(0, len(query), 4096):
                    row = pa.array(query[a : a + 4096])
                    columns = [batch.column(c).take(row) for c in ("vec_id", "v", "floor")]
                    yield pa.RecordBatch.from_arrays([pa.array(at[a : a + 4096], pa.int32()), *columns], names=["cell", "query_id", "v", "floor"])

    return asked.select("vec_id", "v", "floor").mapInArrow(cells, "cell int, query_id long, v array<double>, floor double")


def encode(vectors: DataFrame, middle: np.ndarray, bits: int, seed: int) -> DataFrame:
    """(cell, block, ids, code, length, fit, vectors): blocks of codes, with the length of each residual, its <c, o> and the vectors.

    Vectors that single precision holds exactly are kept in it.
    """
    dim = middle.shape[1]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotation(dim, bits, seed)
        held: dict[tuple[int, int], list] = {}

        def done(key: tuple[int, int]) -> pa.RecordBatch:
            *columns, v = [np.concatenate(x) for x in zip(*held.pop(key), strict=True)]
            short = v.astype(np.float32)
            columns = [c.tobytes() for c in (*columns, short if (short == v).all() else v)]
            return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()) for k in key] + [pa.array([c], pa.binary()) for c in columns], names=["cell", "block", "ids", "code", "length", "fit", "vectors"])

        last = None
        for batch in batches:  # sorted by cell and block
            v, cell, block, ids = _matrix(batch.column("v")), batch.column("cell").to_numpy(), batch.column("block").to_numpy(), batch.column("vec_id").to_numpy()
            rest = v - middle[cell]
            length = np.sqrt((rest * rest).sum(axis=1))
            o = (rest / np.maximum(length, 1e-300)[:, None]) @ turn
            fit = np.where(length > 0, np.abs(o).sum(axis=1) / np.sqrt(bits), 1.0)
            code = np.packbits(o > 0, axis=1)
            starts = np.flatnonzero(np.append(True, (cell[1:] != cell[:-1]) | (block[1:] != block[:-1]))) if len(ids) else []
            for a, b in zip(starts, [*starts[1:], len(ids)], strict=True):
                key = (int(cell[a]), int(block[a]))
                if last not in (None, key):
                    yield done(last)
                held.setdefault(key, []).append((ids[a:b], code[a:b], length[a:b], fit[a:b], v[a:b]))
                last = key
        if last is not None:
            yield done(last)

    dealt = vectors.repartition("cell", "block").sortWithinPartitions("cell", "block")
    return dealt.mapInArrow(pack, "cell int, block int, ids binary, code binary, length binary, fit binary, vectors binary")


def products(words: np.ndarray, ones: np.ndarray, turned: np.ndarray) -> tuple[np.ndarray, float]:
    """<c, q> of every code with a rotated query, from packed bits, and how far the query's rounding may put it off.

    ``words`` has a row for each 64 bits of the codes; ``ones`` counts their set bits.
    """
    bits = len(turned)
    low, step = turned.min(), max(float(np.ptp(turned)) / ((1 << LEVELS) - 1), 1e-300)
    whole = np.rint((turned - low) / step).astype(np.int64)
    sums = np.zeros(words.shape[1], np.int32)
    for level in range(LEVELS):
        plane = np.packbits((whole >> level & 1).astype(np.uint8)).view(np.uint64)
        sums += np.bitwise_count(words & plane[:, None]).sum(axis=0, dtype=np.int32) << level
    # Signs are +-1: <sign, q> = 2 <bit, q> - sum of q, and q = low + step * whole.
    got = 2 * (low * ones + step * sums) - (low * bits + step * whole.sum())
    return got / np.sqrt(bits), float(np.abs(turned - (low + step * whole)).sum() / np.sqrt(bits))


def nearest(ids: np.ndarray, v: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k of ``ids`` with the largest exact products, and those. Components are added in their order, so equal vectors tie."""
    score = np.add.accumulate(v * q, axis=1)[:, -1]
    best = np.lexsort((ids, -score))[:k]
    return ids[best], score[best]


def compared(pairs: DataFrame, middle: np.ndarray, bits: int, k: int, seed: int, epsilon: float) -> DataFrame:
    """(query_id, vec_id, score): at most k rows of each query in each block, chosen by bounds and then by exact products."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, dim = rotation(middle.shape[1], bits, seed), middle.shape[1]
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                ids, length, fit = (np.frombuffer(row[c].as_buffer(), t) for c, t in (("ids", np.int64), ("length", float), ("fit", float)))
                n = len(ids)
                words = np.ascontiguousarray(np.frombuffer(row["code"].as_buffer(), np.uint64).reshape(n, -1).T)
                v = row["vectors"].as_buffer()
                v = np.frombuffer(v, np.float32 if len(v) == 4 * n * dim else float).reshape(n, dim)
                ones = np.bitwise_count(words).sum(axis=0, dtype=np.int32)
                slack = epsilon * np.sqrt(np.maximum(1 - fit**2, 0)) / fit * length / np.sqrt(max(bits - 1, 1))
                out, cell = [], row["cell"].as_py()
                for qid, q, least in zip(row["query_ids"].as_py(), np.frombuffer(row["asked"].as_buffer()).reshape(-1, dim), row["floors"].as_py(), strict=True):
                    got, off = products(words, ones, q @ turn)
                    guess = q @ middle[cell] + got * length / fit
                    error = np.sqrt(q @ q) * slack + off * length / fit + 1e-9 * np.abs(guess)
                    other = ids != qid
                    low = np.where(other, guess - error, -np.inf)
                    floor = max(least, np.partition(low, -k)[-k]) if n > k else least
                    at = np.flatnonzero((guess + error >= floor) & other)
                    best, score = nearest(ids[at], v[at].astype(float), q, k)
                    best, score = best[score >= least], score[score >= least]
                    out.append((np.full(len(best), qid), best, score))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["query_id", "vec_id", "score"])

    return pairs.mapInArrow(compare, "query_id long, vec_id long, score double")


def gathered(queries: DataFrame) -> DataFrame:
    """(cell, query_block, query_ids, asked, floors): the queries that visit a cell, in blocks."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, block = batch.column("cell").to_numpy(), batch.column("query_block").to_numpy()
            v, ids, floors = _matrix(batch.column("v")), batch.column("query_id").to_numpy(), batch.column("floor").to_numpy()
            starts = np.flatnonzero(np.append(True, (cell[1:] != cell[:-1]) | (block[1:] != block[:-1]))) if len(ids) else []
            for a, b in zip(starts, [*starts[1:], len(ids)], strict=True):
                yield pa.RecordBatch.from_pydict({"cell": pa.array([cell[a]], pa.int32()), "query_block": pa.array([block[a]], pa.int32()), "query_ids": pa.array([ids[a:b]], pa.list_(pa.int64())), "asked": [v[a:b].tobytes()], "floors": pa.array([floors[a:b]], pa.list_(pa.float64()))})

    dealt = queries.repartition("cell", "query_block").sortWithinPartitions("cell", "query_block")
    return dealt.mapInArrow(pack, "cell int, query_block int, query_ids array<long>, asked binary, floors array<double>")


def search(vectors: DataFrame, is_query: Column, k: int = 20, seed: int = 7, epsilon: float = 3.0, block: int = 8192, cell: int = CELL) -> DataFrame:
    """The k nearest of every row for which ``is_query`` holds, nearest first."""
    small_batches(vectors.sparkSession)
    rows = saved(usable(vectors), "vectors")
    total = rows.count()
    if not total:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    n_cells = max(1, min(CELLS, total // cell))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toPandas()["v"]
    middle = centres(np.stack(sample.to_list()), n_cells, seed)
    bits = max(BITS, -(-middle.shape[1] // 64) * 64)

    block = max(k + 1, min(block, BLOCK_BYTES // (8 * middle.shape[1])))

    # One row a cell, of which there are at most CELLS; a cell with many vectors or queries has several blocks.
    parts = lambda df, name: F.broadcast(df.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(name)))
    every = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    placed = saved(assigned(rows, middle), "cells")
    sizes, radius = parts(placed, "parts"), radii(placed, len(middle))
    codes = saved(encode(placed.join(sizes, "cell").withColumn("block", salt([F.col("vec_id")], F.col("parts"))), middle, bits, seed), "codes")

    def met(asked: DataFrame, first: bool) -> DataFrame:
        """What queries find in their cells. Both sides are dealt by the pair of blocks, not by the cell."""
        going = saved(visits(asked, middle, radius, first), "visits")
        crowds = parts(going, "query_parts")
        queries = gathered(going.join(crowds, "cell").withColumn("query_block", salt([F.col("query_id")], F.col("query_parts"))))
        queries = queries.join(sizes, "cell").withColumn("block", every("parts")).drop("parts")
        pairs = codes.join(crowds, "cell").withColumn("query_block", every("query_parts")).drop("query_parts")
        return compared(pairs.join(queries.hint("shuffle_merge"), ["cell", "block", "query_block"]), middle, bits, k, seed, epsilon)

    def top(found: DataFrame) -> DataFrame:
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    asked = rows.where(is_query).select("vec_id", "v")
    near = saved(top(met(asked.withColumn("floor", F.lit(float("-inf"))), True)), "nearest")
    floors = near.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
    asked = asked.join(floors, "vec_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    return top(near.drop("rank").unionByName(met(asked, False)))
