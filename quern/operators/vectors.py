"""Cosine search of packed vectors: a chunk of vectors against a block of queries as one matrix product.

A product tells which vectors may be among a query's best; these alone are summed in the order of
`numbers.cosine`, so that the similarities are those of the expression, bit by bit.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors of a chunk, and blocks of queries that are sent to all tasks at a time.
CHUNK, BLOCKS = 2048, 16
#: Queries that meet a chunk at a time.
STEP = 256
#: Products are rounded to six places; closer to a rounding edge than this a value counts for both sides.
PLACES, SLACK = 1e6, 1e-6
#: Stands for no similarity: below all others. A similarity that is not a number is above all others.
NONE, NAN = -9.0, 9.0


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of the rows of a and b (broadcast), summed component by component; NONE where a norm is zero."""
    dot, na, nb = (np.zeros(np.broadcast_shapes(a.shape, b.shape)[:-1]) for _ in range(3))
    with np.errstate(all="ignore"):
        for k in range(a.shape[-1]):
            x, y = a[..., k], b[..., k]
            dot += x * y
            na += x * x
            nb += y * y
        scale = np.sqrt(na) * np.sqrt(nb)
        return np.where(scale == 0, NONE, dot / scale)


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """All cosines, by a matrix product where every norm is ordinary; NAN for what is not a number."""
    with np.errstate(all="ignore"):
        nq, nv = np.sqrt((queries**2).sum(axis=1)), np.sqrt((vectors**2).sum(axis=1))
        tame = all(bool(((n == 0) | ((n > 1e-60) & (n < 1e60))).all()) for n in (nq, nv))
        if not tame:
            return np.nan_to_num(exact(queries[:, None], vectors[None]), nan=NAN)
        out = (queries / np.where(nq == 0, 1, nq)[:, None]) @ (vectors / np.where(nv == 0, 1, nv)[:, None]).T
    out[nq == 0] = NONE
    out[:, nv == 0] = NONE
    return out


def packed(column: pa.Array) -> list[bytes | None]:
    """The components of each vector, as bytes; None for null, and for a vector that holds a null."""
    offsets = column.offsets.to_numpy()
    values = column.values.slice(offsets[0], offsets[-1] - offsets[0])
    offsets = (offsets - offsets[0]).tolist()
    data = values.to_numpy(zero_copy_only=False).astype(np.float64).tobytes()
    rows = [data[8 * lo : 8 * hi] for lo, hi in zip(offsets[:-1], offsets[1:], strict=True)]
    if column.null_count or values.null_count:
        gaps = np.r_[0, np.cumsum(values.is_null().to_numpy(zero_copy_only=False))]
        rows = [None if bad or gaps[hi] > gaps[lo] else row for row, bad, lo, hi in zip(rows, column.is_null().to_pylist(), offsets[:-1], offsets[1:], strict=True)]
    return rows


def needed(keys: list, vectors: list[bytes | None], k: int) -> list[int]:
    """Positions of the first copies of each vector: k of a key and 2 k in all, so that any one key leaves k others."""
    of_key, of_vector, keep = Counter(), Counter(), []
    for at, pair in enumerate(zip(keys, vectors, strict=True)):
        if of_key[pair] < k and of_vector[pair[1]] < 2 * k:
            of_key[pair] += 1
            of_vector[pair[1]] += 1
            keep.append(at)
    return keep


def as_matrix(rows: list[bytes | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(positions, matrix) of the packed vectors of each length; those that are None are left out."""
    by: dict[int, list[int]] = {}
    for at, v in enumerate(rows):
        if v is not None:
            by.setdefault(len(v), []).append(at)
    return [(np.array(at), np.frombuffer(b"".join(rows[k] for k in at), np.float64).reshape(len(at), size // 8)) for size, at in by.items()]


def candidates(asked: list[bytes | None], vectors: list[bytes | None], same: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, cosine) by position: of each query's pairs all that may be among its best k; NONE is no similarity.

    vectors stand in the order that ties go by; same has the positions (query, vector) of one key; least, a
    bound per query from earlier chunks, is raised in place.
    """
    lengths, of = as_matrix(vectors), as_matrix(asked)
    out = []
    for at in range(0, len(asked), STEP):
        rows = np.arange(at, min(at + STEP, len(asked)))
        found = np.full((len(rows), len(vectors)), NONE)
        for positions, matrix in of:
            mine = np.flatnonzero((positions >= at) & (positions < at + STEP))
            for columns, other in lengths:
                if len(mine) and other.shape[1] == matrix.shape[1]:
                    found[np.ix_(positions[mine] - at, columns)] = products(matrix[mine], other)
        own = same[(same[:, 0] >= at) & (same[:, 0] < at + STEP)]
        found[own[:, 0] - at, own[:, 1]] = -np.inf  # a query doesn't meet itself
        if found.shape[1] > k and np.isneginf(least[rows]).any():
            least[rows] = np.maximum(least[rows], np.partition(found, -k, axis=1)[:, -k])
        q, v = np.nonzero((found >= (least[rows] - 2 / PLACES)[:, None]) & ~np.isneginf(found))
        value = found[q, v]
        low, high = (np.floor(value * PLACES + 0.5 + s) for s in (-SLACK, SLACK))
        order = np.lexsort((v, -low, q))
        q, v, value, edge = q[order], v[order], value[order], (high > low)[order]
        first = np.searchsorted(q, np.arange(len(rows)))
        place = np.arange(len(q)) - first[q]
        kth = place == k - 1
        least[q[kth] + at] = np.maximum(least[q[kth] + at], value[kth] - 2 / PLACES)
        keep = (place < k) | edge
        out.append((q[keep] + at, v[keep], value[keep]))
    q, v, value = (np.concatenate(x) for x in zip(*out, strict=True))
    size = np.array([-1 if x is None else len(x) for x in vectors])
    for length in np.unique(size[v]):
        here = np.flatnonzero((size[v] == length) & (value > NONE))
        if length >= 0 and len(here):
            a, b = (np.frombuffer(b"".join(rows[n] for n in at.tolist()), np.float64).reshape(len(here), -1) for rows, at in ((asked, q[here]), (vectors, v[here])))
            value[here] = exact(a, b)
    return q, v, value


def chunks(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(keys, vectors): rows of at most CHUNK vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                part = part.take(pc.sort_indices(part.column("key")))
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(n)) for n in ("key", "vector")], ["keys", "vectors"])

    rows = vectors.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"keys array<{kind}>, vectors array<array<double>>")


def cosine_candidates(vectors: DataFrame, asked: DataFrame, key: str, vector: str, k: int, blocks: int) -> DataFrame:
    """(query, key, similarity): for each row of asked (query, q, block) all vectors that may be among its best k to six places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                block = batch.column("block")[row].as_py()
                keys, lists, queries, of = (batch.column(n)[row].values for n in ("keys", "vectors", "queries", "qs"))
                names, own, stored = keys.to_pylist(), queries.to_pylist(), packed(lists)
                keep = needed(names, stored, k)
                where: dict = {}
                for n, at in enumerate(keep):
                    where.setdefault(names[at], []).append(n)
                same = np.array([(n, at) for n, x in enumerate(own) for at in where.get(x, ())], np.int64).reshape(-1, 2)
                bound = least.setdefault(block, np.full(len(own), -np.inf))
                q, v, value = candidates(packed(of), [stored[at] for at in keep], same, k, bound)
                found = pa.array(value, mask=value == NONE)
                yield pa.RecordBatch.from_arrays([queries.take(pa.array(q)), keys.take(pa.array(np.array(keep, np.int64)[v])), found], ["query", key, "similarity"])

    kind = vectors.schema[key].dataType.simpleString()
    of_query = asked.schema["query"].dataType.simpleString()
    rows = asked.where(F.col("query").isNotNull()).groupBy("block").agg(F.collect_list(F.struct("query", F.col("q").cast("array<double>").alias("q"))).alias("a"))
    rows = rows.select("block", F.col("a.query").alias("queries"), F.col("a.q").alias("qs"))
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = chunks(vectors, key, vector).repartition(parts)
    out = None
    for first in range(0, blocks, BLOCKS):
        met = dealt.crossJoin(F.broadcast(rows.where(F.col("block").between(first, first + BLOCKS - 1))))
        found = met.mapInArrow(run, f"query {of_query}, `{key}` {kind}, similarity double")
        out = found if out is None else out.union(found)
    return out
