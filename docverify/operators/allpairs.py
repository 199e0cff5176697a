"""All pairs of a table's unit vectors, compared in pairs of blocks.

Rows are dealt to blocks, and a task holds two of them: so every pair meets in
one task, and memory is that of two blocks and a tile of products. Products are
taken in 32 bits; where their error might decide, 64 bits do. Nothing is left
out, and the work is quadratic in vectors, at some nanoseconds a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a block's vectors at most, rows of a tile, and pairs that are verified at a time.
BLOCK_BYTES, TILE_ROWS, CHUNK = 32 << 20, 2048, 1 << 16
#: Tasks a core at least, where there are rows enough.
WAVES = 3


def dealt(rows: DataFrame, id_col: str, blocks: int) -> DataFrame:
    """rows with block, once for each pair of blocks that theirs is in, and a partition for each such pair (block, pair)."""
    pairs = block_pairs(blocks)
    met = F.array(*(F.array(*(F.lit(k) for k, x in enumerate(pairs) if own in x)) for own in range(blocks)))
    named = rows.withColumn("block", F.pmod(F.xxhash64(id_col), F.lit(blocks)).cast("int"))
    return named.withColumn("pair", F.explode(F.get(met, F.col("block")))).repartitionById(len(pairs), F.col("pair"))


def block_pairs(blocks: int) -> list[tuple[int, int]]:
    """Pairs of two blocks, then those of a block with itself, which are shorter."""
    return sorted(((p, q) for p in range(blocks) for q in range(p, blocks)), key=lambda x: x[0] == x[1])


def _blocks(rows: int, size: int, cores: int) -> int:
    """Blocks of at most BLOCK_BYTES; more where there are few, so that all cores have work."""
    busy = int(np.ceil((2 * WAVES * cores) ** 0.5))
    return max(1, -(-size // BLOCK_BYTES), min(busy, rows // 256))


def _vectors(rows: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors, a row each, by the vectors' length."""
    sizes, found = pa.compute.list_value_length(rows.column("u")).to_numpy(), {}
    for size in np.unique(sizes).tolist():
        own = rows.filter(pa.array(sizes == size))
        found[size] = own.column("id").to_numpy(), pa.compute.list_flatten(own.column("u")).to_numpy().reshape(-1, size)
    return found


def _hits(one: np.ndarray, other: np.ndarray, alone: bool, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and columns of pairs whose product is at least `least`, tile by tile; alone: of a block with itself, each pair once."""
    slack = (one.shape[1] + 8) * 2.0**-23
    x, y = one.astype(np.float32), other.astype(np.float32)
    for a in range(0, len(x), TILE_ROWS):
        for b in range(a if alone else 0, len(y), TILE_ROWS):
            products = x[a : a + TILE_ROWS] @ y[b : b + TILE_ROWS].T
            if alone and a == b:
                products[np.tril_indices(len(products))] = -2
            found = np.flatnonzero(products >= least - slack)
            i, j = np.divmod(found, products.shape[1])
            i, j = i + a, j + b
            unsure = np.flatnonzero(products.ravel()[found] < least + slack)
            below = [np.einsum("ij,ij->i", one[i[k]], other[j[k]]) < least for k in np.split(unsure, range(CHUNK, len(unsure), CHUNK))]
            if (out := unsure[np.concatenate(below)]).size:
                i, j = np.delete(i, out), np.delete(j, out)
            if len(i):
                yield i, j


def _each_length(batches: Iterator[pa.RecordBatch], pairs: list[tuple[int, int]]) -> Iterator[tuple[tuple, tuple, bool]]:
    """(ids and vectors of one block, of the other, whether they are the same) of a partition, by length."""
    if not (held := list(batches)):
        return
    rows = pa.Table.from_batches(held)
    for pair in rows.column("pair").unique().to_pylist():
        p, q = pairs[pair]
        group = rows.filter(pa.compute.equal(rows.column("pair"), pair))
        one = _vectors(group.filter(pa.compute.equal(group.column("block"), p)))
        other = one if p == q else _vectors(group.filter(pa.compute.equal(group.column("block"), q)))
        for size in sorted(one.keys() & other.keys()):
            yield one[size], other[size], p == q


def _dealt_units(unit: DataFrame) -> tuple[DataFrame, list[tuple[int, int]]]:
    n, numbers = unit.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("u")), F.lit(0))).first()
    blocks = _blocks(n, 8 * numbers, unit.sparkSession.sparkContext.defaultParallelism)
    return dealt(unit.select("id", "u"), "id", blocks).select("id", "u", "block", "pair"), block_pairs(blocks)


def near_pairs(unit: DataFrame, least: float) -> DataFrame:
    """(a, b, similarity), a < b, of all unit vectors (id, u) of one length whose product is at least `least`."""
    rows, pairs = _dealt_units(unit)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (ids, u), (others, v), alone in _each_length(batches, pairs):
            for i, j in _hits(u, v, alone, least):
                for k in range(0, len(i), CHUNK):
                    p, q = i[k : k + CHUNK], j[k : k + CHUNK]
                    one, other, product = ids[p], others[q], np.einsum("ij,ij->i", u[p], v[q])
                    two = one != other
                    columns = np.minimum(one, other)[two], np.maximum(one, other)[two], product[two]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "b", "similarity"])

    return rows.mapInArrow(compared, "a long, b long, similarity double")


def _joined(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the trees of i and j; root holds a node's root, the smallest of its tree."""
    while True:
        p, q = root[i], root[j]
        apart = p != q
        if not apart.any():
            return
        i, j, p, q = i[apart], j[apart], p[apart], q[apart]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while (root[root] != root).any():
            root[:] = root[root]


def near_links(unit: DataFrame, least: float) -> DataFrame:
    """(node, root, n_links) that near_pairs come to: a row a node and task at most, however many pairs there are.

    node and root are ids that the task's pairs connect; n_links, summed over a
    node's rows, is the number of its pairs. Rows that share an id are one node.
    """
    rows, pairs = _dealt_units(unit)

    def connected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (ids, u), (others, v), alone in _each_length(batches, pairs):
            shift = 0 if alone else len(ids)
            every = ids if alone else np.concatenate([ids, others])
            root, many = np.arange(len(every)), np.zeros(len(every), np.int64)
            for i, j in _hits(u, v, alone, least):
                j = j + shift
                two = every[i] != every[j]
                i, j = i[two], j[two]
                many += np.bincount(i, minlength=len(many)) + np.bincount(j, minlength=len(many))
                _joined(root, i, j)
            linked = np.flatnonzero(many)
            columns = every[linked], every[root[linked]], many[linked]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["node", "root", "n_links"])

    return rows.mapInArrow(connected, "node long, root long, n_links long")
