"""Exact join of vectors by a least cosine, block by block, pruned by angles to pivots.

Rows are dealt to blocks of bounded size. A job a block sends it to all tasks, and they compare their rows with it in tiles:
a bound from half the dimensions, in single precision, tells which pairs are worth the exact cosine. No row is copied to several tasks, and what a worker
holds is one block and one tile, however many rows or pairs there are.

Vectors are assigned to the nearest of a bounded number of pivots. A list's members lie within its radius of
the pivot, so by the triangle inequality on angles a vector can have a partner only in lists whose pivot is
within radius + arccos(threshold); other lists of the block are left out of a tile. Nothing is approximate.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftmark.runtime import materialize, release

PIVOTS = 256
BLOCK = 65_536
TILE, COLUMNS = 512, 4096  # rows and columns of a product
EXACT = 32_768  # pairs whose exact cosine is taken at once
SPLIT = 16_384  # rows a file at most, about
SLACK = 1e-7


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _angles(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit @ pivots.T, -1, 1))


def _basis(sample: np.ndarray, dim: int) -> np.ndarray:
    """Orthonormal directions (columns), half as many as ``dim`` less one, in which the sample is largest; few dimensions stay."""
    if dim < 16:
        return np.eye(dim)
    return np.linalg.eigh(sample.T @ sample)[1][:, ::-1][:, : dim // 2 - 1]


def _narrow(unit: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Coordinates in the basis, then the length of what it leaves out: products of these are never below the cosine."""
    head = unit @ basis
    rest = np.sqrt(np.maximum((unit * unit).sum(axis=1) - (head * head).sum(axis=1), 0))
    return np.hstack([head, rest[:, None]]).astype(np.float32)


def _tile(q: np.ndarray, c: np.ndarray, narrow_q: np.ndarray, narrow_c: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, columns, cosines) of the pairs of ``threshold`` or a little less."""
    slack = (q.shape[1] + 8) * 2.0**-23 + 1e-7  # over the error of a product of unit vectors in single precision, and of the rest's length
    near = np.flatnonzero(narrow_q @ narrow_c.T >= threshold - slack)
    norm_q, norm_c = np.sqrt((q * q).sum(axis=1)), np.sqrt((c * c).sum(axis=1))
    for at in range(0, len(near), EXACT):
        rows, cols = np.divmod(near[at : at + EXACT], len(c))
        whole = norm_q[rows] * norm_c[cols]
        cos = np.divide(np.einsum("ij,ij->i", q[rows], c[cols]), whole, out=np.zeros(len(rows)), where=whole > 0)
        keep = cos >= threshold - 1e-9
        yield rows[keep], cols[keep], cos[keep]


def cosine_pairs(vectors: DataFrame, threshold: float, dim: int, pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """(a, b, cosine), a < b, of all pairs of rows with cosine ``threshold`` or more, to 12 digits.

    ``vectors``: item BIGINT (unique), vector ARRAY of ``dim`` numbers. A zero vector has cosine 0 with every
    vector, itself too. No rows give no pairs.
    """
    spark = vectors.sparkSession
    vectors = vectors.select("item", F.transform("vector", lambda x: x.cast("double")).alias("vector"))
    vectors = materialize(vectors.filter(F.exists("vector", lambda x: x != 0)) if threshold > 0 else vectors)
    n = vectors.count()
    if n < 2:
        return spark.createDataFrame([], "a long, b long, cosine double")
    want = min(pivots, max(1, round(math.sqrt(n) / 2)))
    sample = vectors.orderBy(F.xxhash64("item")).limit(4 * want).toArrow()
    x = _unit(_matrix(sample["vector"], dim))
    x = x[np.linalg.norm(x, axis=1) > 0]
    chosen = x[:1]
    for _ in range(min(want, len(x)) - 1):  # farthest first, so that radii are small
        chosen = np.vstack([chosen, x[np.argmin((x @ chosen.T).max(axis=1))]])
    if not len(chosen):
        chosen = np.eye(1, dim)
    basis = _basis(x, dim)
    shared = spark.sparkContext.broadcast(chosen)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            home = np.nan_to_num(_unit(_matrix(batch.column("vector"), dim)) @ shared.value.T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("item"), batch.column("vector"), pa.array(home.astype(np.int32))], ["item", "vector", "home"])

    blocks = -(-n // block)
    dealt = vectors.repartition(max(spark.sparkContext.defaultParallelism, -(-n // SPLIT)), "item").mapInArrow(assign, "item long, vector array<double>, home int")
    homed = materialize(dealt.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int")).sortWithinPartitions("home"))
    release(vectors)
    found = None
    for number in range(blocks):
        pairs = _pairs_of_block(homed, number, chosen, basis, threshold, dim)
        found = pairs if found is None else found.unionByName(pairs)
    release(homed)
    return found.withColumn("cosine", F.round("cosine", 12)).filter(F.col("cosine") >= threshold)


def _pairs_of_block(homed: DataFrame, number: int, chosen: np.ndarray, basis: np.ndarray, threshold: float, dim: int) -> DataFrame:
    """Pairs of the rows of a block with each other and with those of later blocks."""
    held = homed.filter(F.col("block") == number).select("item", "vector", "home").toArrow()
    order = np.argsort(held["home"].to_numpy(), kind="stable")
    items, homes, matrix = held["item"].to_numpy()[order], held["home"].to_numpy()[order], _matrix(held["vector"], dim)[order]
    angles = np.nan_to_num(_angles(_unit(matrix), chosen)[np.arange(len(homes)), homes]) if len(homes) else np.zeros(0)
    radius = np.full(len(chosen), -10.0)
    np.maximum.at(radius, homes, angles)
    reach = radius + math.acos(max(-1.0, min(1.0, threshold))) + SLACK
    starts = np.searchsorted(homes, np.arange(len(chosen) + 1))
    shared = homed.sparkSession.sparkContext.broadcast((items, matrix, starts, reach, chosen, basis))
    del held, items, homes, matrix

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, matrix, starts, reach, chosen, basis = shared.value
        narrow = _narrow(_unit(matrix), basis)
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def made() -> pa.RecordBatch:
            a, b, cos = (np.concatenate(x) for x in zip(*kept))
            kept.clear()
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(cos)], ["a", "b", "cosine"])

        for batch in batches:
            for at in range(0, batch.num_rows, TILE):
                part = batch.slice(at, TILE)
                item, later, q = part.column("item").to_numpy(), part.column("block").to_numpy() > number, _matrix(part.column("vector"), dim)
                unit = _unit(q)
                open_ = (_angles(unit, chosen) <= reach).any(axis=0) if threshold > 0 else np.ones(len(chosen), dtype=bool)
                edges = np.flatnonzero(np.diff(np.concatenate([[False], open_, [False]]).astype(np.int8)))
                short = _narrow(unit, basis)
                for low, high in zip(starts[edges[::2]], starts[edges[1::2]]):
                    for to in range(low, high, COLUMNS):
                        side = slice(to, min(to + COLUMNS, high))
                        for rows, cols, cos in _tile(q, matrix[side], short, narrow[side], threshold):
                            x, y = item[rows], items[side][cols]
                            keep = later[rows] | (x < y)
                            if keep.any():
                                kept.append((x[keep], y[keep], cos[keep]))
                                size += int(keep.sum())
                            if size >= 4 * EXACT:
                                yield made()
                                size = 0
        if kept:
            yield made()

    rows = homed.filter(F.col("block") >= number).select("item", "vector", "block")
    pairs = materialize(rows.mapInArrow(scan, "a long, b long, cosine double"))
    shared.destroy()  # the pairs are written
    return pairs
