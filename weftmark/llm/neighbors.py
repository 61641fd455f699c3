"""Most similar vectors of every vector: inverted lists and an adaptive dimension scan.

Unit vectors are turned by a random rotation, so any d of the D coordinates are a fair sample of a distance.
Spherical k-means on a bounded sample of rows gives the lists; every vector is indexed, and asks the
``nprobe`` lists of the nearest centroids. Within a list squared distances are summed block of coordinates by
block. After each block a candidate is abandoned if the hypothesis that its distance is within the query's
bound is rejected: its partial distance, scaled by D / d, is over the bound by the factor 1 + e / sqrt(d).

Lists are cut into chunks of candidates and of queries, and each pair of chunks is a group of its own, so a
list that holds a third of all vectors is spread over the cluster. Exact copies are collapsed to one vector
first and expanded at the end, so a large group of copies costs one vector.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftmark.runtime import materialize

SAMPLE = 65_536  # rows on which rotation and centroids are fitted
BLOCKS = (24, 44)  # coordinates after which candidates are tested
TEST = 2.1  # e of the test
SPARSE = 0.04  # share of candidates left from which they are taken one by one
CANDIDATES, QUERIES = 4096, 16_384  # most candidates and queries of a group
PROBES = 12


def usable_vectors(df: DataFrame, key: str, vector: str, dims: int) -> DataFrame:
    """(id, vector): one row an id; vectors of another length, all zero, or with null or non-finite numbers left out."""
    return (
        df.select(F.col(key).alias("id"), F.col(vector).alias("vector"))
        .filter(F.col("id").isNotNull() & (F.size("vector") == dims))
        .filter(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0))
        .dropDuplicates(["id"])
    )


def fit(sample: np.ndarray, lists: int, rounds: int = 10, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(rotation, centroids in rotated coordinates) of unit vectors."""
    rng = np.random.default_rng(seed)
    rotation = np.linalg.qr(rng.normal(size=(sample.shape[1], sample.shape[1])))[0].astype(np.float32)
    x = (sample @ rotation).astype(np.float32)
    centroids = x[rng.choice(len(x), min(lists, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([(part @ centroids.T).argmax(1) for part in np.array_split(x, max(1, len(x) // 8192))])
        order = np.argsort(near, kind="stable")
        starts = np.flatnonzero(np.diff(near[order], prepend=-1))
        sums = np.add.reduceat(x[order], starts, axis=0)
        centroids[near[order][starts]] = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return rotation, centroids


def _unit(column: pa.Array, dims: int) -> np.ndarray:
    x = np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dims)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _binary(rows: np.ndarray) -> pa.Array:
    width = rows.shape[1] * 4
    ends = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(rows, dtype=np.float32))])


def _first_bound(q: np.ndarray, ids: np.ndarray, items: np.ndarray, item_ids: np.ndarray, far: np.ndarray, k: int, least: float) -> np.ndarray:
    """Product that a candidate must reach: that of the k-th of the items nearest so far, ``least`` at least."""
    bound = np.full(len(q), least, dtype=np.float32)
    if len(items) > 2 * k:
        seeds = np.argpartition(far, 2 * k - 1, axis=1)[:, : 2 * k]
        full = np.einsum("qd,qsd->qs", q, items[seeds])
        full[ids[:, None] == item_ids[seeds]] = -9.0
        bound = np.maximum(bound, np.partition(full, k, axis=1)[:, k])
    return bound


def scan(queries: np.ndarray, query_ids: np.ndarray, items: np.ndarray, item_ids: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, item id, product) of up to ``k`` best items of each query with product ``least`` or more, itself left out."""
    dims = items.shape[1]
    cuts = [*(c for c in BLOCKS if c < dims), dims]
    factor = [dims / c / (1 + TEST / math.sqrt(c)) ** 2 for c in cuts[:-1]] + [1.0]
    columns = [np.ascontiguousarray(items[:, a:b].T) for a, b in zip([0, *cuts], cuts)]
    norms = [(x * x).sum(axis=0) for x in columns]
    out_q, out_i, out_v = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.float32)]
    for at in range(0, len(queries) if len(items) else 0, 512):
        q, ids = queries[at : at + 512], query_ids[at : at + 512]
        far = None
        for n, (a, b) in enumerate(zip([0, *cuts], cuts)):  # all candidates, as long as many are left
            part = q[:, a:b]
            gap = (part * part).sum(axis=1)[:, None] + norms[n][None, :] - 2 * (part @ columns[n])
            if far is None:
                far = gap
                far[ids[:, None] == item_ids[None, :]] = 99.0
                limit = np.maximum(2 - 2 * _first_bound(q, ids, items, item_ids, far, k, least), 0) + 1e-6
            else:
                far += gap
            keep = far * factor[n] <= limit[:, None]
            if n + 1 == len(cuts) or np.count_nonzero(keep) < SPARSE * keep.size:
                break
        rows, cols = np.nonzero(keep)
        value = far[rows, cols]
        for a, b, f in zip(cuts[n:], cuts[n + 1 :], factor[n + 1 :]):  # then only those left
            gap = q[rows, a:b] - items[cols, a:b]
            value = value + np.einsum("ij,ij->i", gap, gap)
            keep = value * f <= limit[rows]
            rows, cols, value = rows[keep], cols[keep], value[keep]
        value = 1 - value / 2
        keep = value > -2.0
        rows, cols, value = rows[keep], cols[keep], value[keep]
        order = np.lexsort((item_ids[cols], -value, rows))
        rows, cols, value = rows[order], cols[order], value[order]
        first = np.searchsorted(rows, rows, side="left")
        best = np.arange(len(rows)) - first < k
        out_q.append(ids[rows[best]])
        out_i.append(item_ids[cols[best]])
        out_v.append(value[best])
    return np.concatenate(out_q), np.concatenate(out_i), np.concatenate(out_v)


def _vectors(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    array = column.combine_chunks()
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks)
    data = np.frombuffer(array.buffers()[2], dtype=np.uint8) if len(array) else np.empty(0, np.uint8)
    start = array.offset * dims * 4
    return data[start : start + len(array) * dims * 4].view(np.float32).reshape(-1, dims)


def nearest(vectors: DataFrame, dims: int, k: int, least: float = -1.0, nprobe: int = PROBES, lists: int | None = None) -> DataFrame:
    """(row, other, product): for each row of ``vectors`` (row BIGINT, vector) up to ``k`` rows of largest cosine.

    Approximate: rows of lists not asked are missed, and the tests abandon a true neighbour rarely. The fit uses
    a sample of at most about 65,536 rows chosen by hash; all rows are indexed.
    """
    spark = vectors.sparkSession
    n = vectors.count()
    count = lists or max(1, min(4096, round(math.sqrt(n) / 4)))
    share = min(1.0, SAMPLE / max(n, 1))
    sample = vectors.filter(F.pmod(F.xxhash64("row"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))).select("vector").limit(2 * SAMPLE).toArrow()
    if not sample.num_rows:
        return spark.createDataFrame([], "row long, other long, product float")
    rotation, centroids = fit(_unit(pa.concat_arrays(sample["vector"].chunks), dims), count)
    asked = min(nprobe, len(centroids))
    model = spark.sparkContext.broadcast((rotation, centroids))  # at most 4096 centroids

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, centres = model.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = (_unit(batch.column(1), dims) @ turn).astype(np.float32)
            near = x @ centres.T
            top = np.argpartition(-near, asked - 1, axis=1)[:, :asked] if asked < len(centres) else np.tile(np.arange(asked), (len(x), 1))
            probes = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * asked), pa.array(top.astype(np.int32).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), _binary(x), pa.array(near.argmax(1).astype(np.int32)), probes], ["row", "vec", "home", "probes"])

    indexed = materialize(vectors.select("row", "vector").mapInArrow(index, "row long, vec binary, home int, probes array<int>"))
    held = {r["home"]: r["count"] for r in indexed.groupBy("home").count().collect()}
    asks = {r["p"]: r["count"] for r in indexed.select(F.explode("probes").alias("p")).groupBy("p").count().collect()}
    plan = [(p, math.ceil(held[p] / CANDIDATES), math.ceil(asks[p] / QUERIES)) for p in asks if p in held]
    chunks = F.broadcast(spark.createDataFrame(plan, "list int, cs int, qs int"))  # one row a list
    spread = F.xxhash64("row")
    items = (
        indexed.select("row", "vec", F.col("home").alias("list")).join(chunks, "list")
        .select("list", F.pmod(spread, F.col("cs")).cast("int").alias("c"), F.explode(F.sequence(F.lit(0), F.col("qs") - 1)).alias("q"), F.lit(False).alias("asks"), "row", "vec")
    )
    queries = (
        indexed.select("row", "vec", F.explode("probes").alias("list")).join(chunks, "list")
        .select("list", F.explode(F.sequence(F.lit(0), F.col("cs") - 1)).alias("c"), F.pmod(spread, F.col("qs")).cast("int").alias("q"), F.lit(True).alias("asks"), "row", "vec")
    )

    def group(table: pa.Table) -> pa.Table:
        x, ids = _vectors(table["vec"], dims), table["row"].to_numpy()
        asking = table["asks"].to_numpy(zero_copy_only=False).astype(bool)
        a, b, v = scan(x[asking], ids[asking], x[~asking], ids[~asking], k, least)
        return pa.table({"row": a.astype(np.int64), "other": b.astype(np.int64), "product": v.astype(np.float32)})

    found = items.unionByName(queries).groupBy("list", "c", "q").applyInArrow(group, "row long, other long, product float")
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("product"), "other"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank")


def neighbors(df: DataFrame, key: str = "id", vector: str = "embedding", k: int = 10, least: float = -1.0, dims: int = 64, nprobe: int = PROBES) -> DataFrame:
    """(id, neighbor_id, rank, cosine): up to ``k`` other ids of largest cosine of every id with a usable vector.

    Equal cosines are ranked by id. Ids with equal vectors have cosine 1 with each other. With ``least`` only
    neighbours of at least this cosine come out. Fewer than ``k`` come out where the lists asked hold fewer.
    """
    usable = materialize(usable_vectors(df, key, vector, dims))
    # the first k + 1 ids of each group of copies; the limit works before the shuffle
    turn = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    first = materialize(usable.withColumn("turn", turn).filter(F.col("turn") <= k + 1))
    groups = materialize(first.filter("turn = 1").select(F.monotonically_increasing_id().alias("row"), "vector"))
    named = materialize(first.join(groups, "vector").select("row", "id", "turn"))
    links = nearest(groups.select("row", "vector"), dims, k, least - 1e-5, nprobe)
    choices = links.join(named.filter(F.col("turn") <= k).select(F.col("row").alias("other"), F.col("id").alias("neighbor_id")), "other").select("row", "neighbor_id", F.least(F.col("product").cast("double"), F.lit(1.0)).alias("cosine"))
    own = named.groupBy("row").agg(F.count("*").alias("n")).filter("n > 1").select("row").join(named, "row").select("row", F.col("id").alias("neighbor_id"), F.lit(1.0).alias("cosine"))
    ranked = Window.partitionBy("row").orderBy(F.desc("cosine"), "neighbor_id")
    offered = choices.unionByName(own).withColumn("at", F.row_number().over(ranked)).filter(F.col("at") <= k + 1)
    members = usable.join(groups, "vector").select("row", "id")
    mine = Window.partitionBy("id").orderBy("at")
    out = members.join(offered, "row").filter(F.col("id") != F.col("neighbor_id")).withColumn("rank", F.row_number().over(mine)).filter(F.col("rank") <= k)
    return out.select("id", "neighbor_id", "rank", "cosine")


def similar_pairs(df: DataFrame, key: str = "id", vector: str = "embedding", k: int = 10, least: float = 0.9, dims: int = 64, nprobe: int = PROBES) -> DataFrame:
    """(id_a, id_b), id_a < id_b: one is among the ``k`` most similar of the other and their cosine is ``least`` or more.

    The cosine is taken again from the vectors as stored, in double precision.
    """
    near = neighbors(df, key, vector, k, least, dims, nprobe)
    pairs = near.select(F.least("id", "neighbor_id").alias("id_a"), F.greatest("id", "neighbor_id").alias("id_b")).distinct()
    stored = usable_vectors(df, key, vector, dims)
    a = stored.select(F.col("id").alias("id_a"), F.col("vector").alias("x"))
    b = stored.select(F.col("id").alias("id_b"), F.col("vector").alias("y"))

    def product(p: str, q: str):
        return F.aggregate(F.zip_with(p, q, lambda s, t: s * t), F.lit(0.0), lambda acc, s: acc + s)

    cosine = product("x", "y") / (F.sqrt(product("x", "x")) * F.sqrt(product("y", "y")))
    return pairs.join(a, "id_a").join(b, "id_b").filter(cosine >= least).select("id_a", "id_b")
