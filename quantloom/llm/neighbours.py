"""Nearest neighbours by a block matrix join of int8 products with error bounds.

Vectors are packed into blocks by a hash of their id, queries and candidates apart. Every pair of a query block and a
candidate block is a tile, joined by the two block numbers, so no task sees more than a few blocks and no row of the
output of the join is a pair of vectors. In a tile, vectors are rounded to int8 with a scale of their own; the product of
the two int8 matrices, exact in float32 arithmetic, gives every distance up to a bound from the rounding errors' norms.
Candidates whose lower bound exceeds the k-th upper bound can't be among the k nearest; the rest are recomputed in double
precision, and heaps keep the k nearest of a tile. The lists of all tiles are merged by query.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

#: Rows of a block. Query blocks are copied once for each candidate block and the other way round, so that blocks of one
#: size send the fewest rows.
QUERY_BLOCK = 4096
CANDIDATE_BLOCK = 4096
#: Queries multiplied at a time.
ROWS = 64


def _packing(limit: int):
    """For `mapInArrow` over (block, id, vector) sorted by block: (block, dim, ids, vectors), at most `limit` rows each."""

    def packed(block: int, ids: list[int], vectors: list[np.ndarray]):
        sizes = np.array([len(v) for v in vectors])
        for dim in np.unique(sizes):
            rows = np.flatnonzero(sizes == dim)
            yield block, int(dim), np.array([ids[r] for r in rows], dtype=np.int64).tobytes(), np.stack([vectors[r] for r in rows]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, ids, vectors = None, [], []
        for batch in batches:
            out = []
            column = batch.column("vector")
            values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            for row, (block, key) in enumerate(zip(batch.column("block").to_pylist(), batch.column("id").to_pylist(), strict=True)):
                if ids and (block != current or len(ids) == limit):
                    out += packed(current, ids, vectors)
                    ids, vectors = [], []
                current = block
                ids.append(key)
                vectors.append(values[offsets[row] : offsets[row + 1]].astype(np.float64))
            if out:
                yield pa.RecordBatch.from_pydict({k: list(v) for k, v in zip(("block", "dim", "ids", "vectors"), zip(*out, strict=True), strict=True)}, schema=SCHEMA)
        if ids:
            out = list(packed(current, ids, vectors))
            yield pa.RecordBatch.from_pydict({k: list(v) for k, v in zip(("block", "dim", "ids", "vectors"), zip(*out, strict=True), strict=True)}, schema=SCHEMA)

    return run


SCHEMA = pa.schema([("block", pa.int32()), ("dim", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary())])


def blocks(vectors: DataFrame, size: int) -> tuple[DataFrame, int]:
    """Packed blocks of about `size` rows and the number of block numbers; equal ids have one number, cut into rows of `size`."""
    number = max(1, -(-vectors.count() // size))
    dealt = vectors.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(number)).cast("int"))
    rows = dealt.repartition("block").sortWithinPartitions("block").select("block", "id", "vector")
    return materialize(rows.mapInArrow(_packing(size), "block int, dim int, ids binary, vectors binary"), "blocks"), number


def rounded(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, scales, norms of the rounded vectors, norms of the rounding errors."""
    scale = np.abs(vectors).max(axis=1) / 127
    scale = np.where(scale > 0, scale, 1.0)
    small = np.rint(vectors / scale[:, None]).astype(np.int8)
    back = small * scale[:, None]
    return small, scale, np.sqrt((back**2).sum(axis=1)), np.sqrt(((vectors - back) ** 2).sum(axis=1))


def exact_distances(query: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, squares summed from the first component to the last."""
    total = np.zeros(len(candidates))
    for j in range(candidates.shape[1]):
        total += (candidates[:, j] - query[j]) ** 2
    return np.sqrt(total)


def tile_nearest(query_ids, queries, ids, candidates, k: int) -> Iterator[tuple[int, int, float]]:
    """The k nearest candidates of other ids for every query of a tile, as (query id, id, distance)."""
    qs, qscale, qnorm, qerror = rounded(queries)
    cs, cscale, cnorm, cerror = rounded(candidates)
    cfloat = cs.astype(np.float32).T.copy()
    squares, qsquares = (candidates**2).sum(axis=1), (queries**2).sum(axis=1)
    whole = np.sqrt(squares)
    for begin in range(0, len(queries), ROWS):
        rows = slice(begin, begin + ROWS)
        product = np.zeros((len(queries[rows]), len(candidates)))
        for j in range(0, queries.shape[1], 1024):  # sums of 1024 products of int8 are exact in float32
            product += qs[rows, j : j + 1024].astype(np.float32) @ cfloat[j : j + 1024]
        middle = qsquares[rows, None] + squares[None, :] - 2 * product * qscale[rows, None] * cscale[None, :]
        slack = 2 * (qnorm[rows, None] * cerror[None, :] + qerror[rows, None] * whole[None, :]) + 1e-9 * (qsquares[rows, None] + squares[None, :])
        for i in range(len(product)):
            q = begin + i
            others = ids != query_ids[q]
            upper = (middle[i] + slack[i])[others]
            near = others & ~(middle[i] - slack[i] > np.partition(upper, k - 1)[k - 1]) if len(upper) > k else others
            rest = np.flatnonzero(near)
            found = exact_distances(queries[q], candidates[rest])
            for distance, key in heapq.nsmallest(k, zip(found.tolist(), ids[rest].tolist(), strict=True)):
                yield int(query_ids[q]), key, distance


def _tiles(k: int):
    """For `mapInArrow` over joined blocks: the nearest of every tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row in range(len(batch)):
                dim, qids, qs, ids, cs = (batch.column(c)[row].as_py() for c in ("dim", "q_ids", "q_vectors", "ids", "vectors"))
                unpack = lambda b: np.frombuffer(b, dtype=np.float64).reshape(-1, dim)
                with np.errstate(over="ignore", invalid="ignore"):
                    found += tile_nearest(np.frombuffer(qids, np.int64), unpack(qs), np.frombuffer(ids, np.int64), unpack(cs), k)
            left, right, score = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64()), pa.array(score, pa.float64())], names=["query_id", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, is_query: str, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for every query row its k nearest rows of another id, ties to the smaller id.

    `is_query` is a condition on `id`. Rows whose id or vector is NULL, or whose vector is zero or empty or holds a NULL or
    non-finite component, take no part; vectors of different lengths aren't compared. Where rows share an id, one row
    with the least vector stands for them. Other columns are ignored; no queries, no rows.
    """
    spark = vectors.sparkSession
    v = F.col("vector")
    usable = (
        (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    )
    taken = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where("id is not null").where(usable)
    rows = materialize(taken.groupBy("id").agg(F.min("vector").alias("vector")), "vectors")
    candidates, n_candidates = blocks(rows, CANDIDATE_BLOCK)
    queries, n_queries = blocks(rows.where(is_query), QUERY_BLOCK)
    left = queries.select(F.col("block").alias("q_block"), "dim", F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(n_candidates - 1)))
    )
    right = candidates.withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    tile = ["q_block", "block", "dim"]
    # Spark knows the size of the blocks but not that of their copies, so that it would broadcast any number of these.
    tiles = left.repartition(parts, *tile).hint("merge").join(right.repartition(parts, *tile), tile)
    found = tiles.select("dim", "q_ids", "q_vectors", "ids", "vectors").mapInArrow(_tiles(k), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
