"""Hashing embedder and cosine.

The embedder counts character trigrams in ``dim`` buckets. Counts stay integers, so products and norms are
exact and cosines do not depend on the order of summation; the unit vector is made only for output.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIM = 64


def bucket(trigram: Column, dim: int = DIM) -> Column:
    """Bucket of a trigram: its MD5 as a number, modulo ``dim``."""
    digest = F.md5(F.encode(trigram, "UTF-8"))
    rest = F.lit(0).cast("long")
    for at in range(1, 33, 8):
        part = F.conv(F.substring(digest, at, 8), 16, 10).cast("long")
        rest = (rest * (2**32 % dim) + part) % dim
    return rest.cast("int")


KNOWN_GRAMS = 1_000_000  # trigrams whose bucket a worker keeps
_buckets: dict[int, dict[int, int]] = {}


def _bucket_numbers(grams: np.ndarray, dim: int) -> np.ndarray:
    """Buckets of trigrams given as 21 bits a code point."""
    known = _buckets.setdefault(dim, {})
    if len(known) > KNOWN_GRAMS:
        known.clear()
    out = np.empty(len(grams), dtype=np.int64)
    for i, g in enumerate(grams.tolist()):
        b = known.get(g)
        if b is None:
            text = chr(g >> 42) + chr(g >> 21 & 0x1FFFFF) + chr(g & 0x1FFFFF)
            b = known[g] = int.from_bytes(hashlib.md5(text.encode()).digest(), "big") % dim
        out[i] = b
    return out


def count_rows(texts: list[str | None], dim: int) -> np.ndarray:
    """Counts of the trigrams of each text (row) by bucket (column)."""
    sizes = np.fromiter((len(t) if t else 0 for t in texts), dtype=np.int64, count=len(texts))
    points = np.frombuffer("".join(t for t in texts if t).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    if len(points) < 3:
        return np.zeros((len(texts), dim), dtype=np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    whole = owner[:-2] == owner[2:]
    grams, place = np.unique(((points[:-2] << 42) | (points[1:-1] << 21) | points[2:])[whole], return_inverse=True)
    cells = owner[:-2][whole] * dim + _bucket_numbers(grams, dim)[place]
    return np.bincount(cells, minlength=len(texts) * dim).reshape(len(texts), dim)


def _arrow_counts(counts: np.ndarray) -> pa.Array:
    """Rows of counts as lists of (bucket, n) of what is not 0, in bucket order."""
    rows, buckets = np.nonzero(counts)
    ends = np.searchsorted(rows, np.arange(len(counts) + 1)).astype(np.int32)
    items = pa.StructArray.from_arrays([pa.array(buckets.astype(np.int32)), pa.array(counts[rows, buckets].astype(np.int64))], ["bucket", "n"])
    return pa.ListArray.from_arrays(pa.array(ends), items)


def counted(rows: DataFrame, keys: list[str], plus: Column, minus: Column | None = None, dim: int = DIM) -> DataFrame:
    """(keys, counts ARRAY<STRUCT<bucket, n>>, square): trigrams of ``plus`` less those of ``minus`` by bucket, row by row.

    Nothing is shuffled; rows without any count are left out. ``square`` is the sum of the squared counts.
    """
    given = rows.select(F.struct(*keys).alias("key"), plus.alias("plus"), (F.lit(None).cast("string") if minus is None else minus).alias("minus"))
    kind, two = given.schema["key"].dataType.simpleString(), minus is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):  # texts may be long
                batch = whole.slice(at, 1024)
                counts = count_rows(batch.column(1).to_pylist(), dim)
                if two:
                    counts = counts - count_rows(batch.column(2).to_pylist(), dim)
                used = np.flatnonzero(counts.any(axis=1))
                counts = counts[used]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(used)), _arrow_counts(counts), pa.array((counts * counts).sum(axis=1))], ["key", "counts", "square"])

    out = given.mapInArrow(run, f"key {kind}, counts array<struct<bucket:int,n:bigint>>, square bigint")
    return out.select(*[F.col(f"key.{k}").alias(k) for k in keys], "counts", "square")


def hashed(texts: DataFrame, keys: list[str], text: str, dim: int = DIM) -> DataFrame:
    """(keys, counts ARRAY<STRUCT<bucket, n>>, square): sparse counts of each padded, lower-case text and their summed squares.

    ``keys`` name a row each. A text of n characters has n trigrams; texts without any are missing from the result
    and embed as the zero vector.
    """
    return counted(texts, keys, F.concat(F.lit(" "), F.lower(F.col(text)), F.lit(" ")), dim=dim)


def trigram_buckets(texts: DataFrame, keys: list[str], text: str, dim: int = DIM) -> DataFrame:
    """(keys, bucket, n): how many trigrams of a padded, lower-case text fall in each bucket."""
    return hashed(texts, keys, text, dim).select(*keys, F.explode("counts").alias("c")).select(*keys, "c.bucket", "c.n")


def dense(counts: Column, dim: int = DIM) -> Column:
    """Counts as an array of ``dim`` numbers; all zero for null."""
    table = F.map_from_entries(counts)
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at(table, i), F.lit(0).cast("long")))


def embedding(counts: Column, square: Column, dim: int = DIM) -> Column:
    """Unit vector of hashed counts, or the zero vector."""
    norm = F.sqrt(F.coalesce(square, F.lit(0)).cast("double"))
    return F.transform(dense(counts, dim), lambda x: F.when(norm > 0, x / norm).otherwise(F.lit(0.0)))


def sparse_dot(counts: Column, dense_counts: Column) -> Column:
    """Exact product of sparse counts with a dense array."""
    return F.aggregate(counts, F.lit(0).cast("long"), lambda acc, x: acc + x["n"] * F.get(dense_counts, x["bucket"]))


def count_cosine(dot: Column, square_a: Column, square_b: Column) -> Column:
    """Cosine from integer product and squares, 0 for a zero vector, to 12 digits."""
    whole = square_a.cast("double") * square_b.cast("double")
    return F.round(F.when(whole > 0, F.coalesce(dot, F.lit(0)).cast("double") / F.sqrt(whole)).otherwise(F.lit(0.0)), 12)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, over the length of the shorter; 0 if either is all zero or empty."""
    n = F.least(F.size(a), F.size(b))

    def product(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda acc, v: acc + v)

    whole = F.sqrt(product(a, a)) * F.sqrt(product(b, b))
    short_a, short_b = F.slice(a, F.lit(1), F.greatest(n, F.lit(0))), F.slice(b, F.lit(1), F.greatest(n, F.lit(0)))
    return F.when(whole > 0, product(short_a, short_b) / whole).otherwise(F.lit(0.0))
