"""Embedding near-duplicates by int8 tile products with rigorous error bounds.

Vectors are normalised and quantised to int8 with one scale each. With x = s*q + e
(|x| = 1, |e| = eps) the quantised product is off by at most
``eps_x + (1 + eps_x) * eps_y`` (Cauchy-Schwarz), so a pair whose quantised
product plus that bound stays under the threshold cannot be a link. Only the
other pairs are computed again in double precision.

Equal vectors are one row with a multiplicity before any product. The distinct
vectors are dealt into blocks; a tile is a pair of blocks, so the work is a grid
of bounded tasks. A tile returns per vector the number of links and a spanning
forest of its links: rows grow with the vectors, not with the pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docprep.llm.common import materialise
from docprep.llm.components import connected_components

THRESHOLD = 0.9
BLOCK = 8192  # distinct vectors of a block, on average
_STRIP = 1024  # rows of a product held at once
_SLACK = 1e-9  # rounding of the bound itself


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit rows -> (int8 codes, scales, norms of the quantisation errors)."""
    scale = np.abs(x).max(axis=1) / 127.0
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    err = np.sqrt(((x - codes * scale[:, None]) ** 2).sum(axis=1))
    return codes, scale, err


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable in the graph of the pairs (a, b)."""
    low = np.arange(n)
    while True:
        m = np.minimum(low[a], low[b])
        new = low.copy()
        np.minimum.at(new, a, m)
        np.minimum.at(new, b, m)
        new = new[new]
        if np.array_equal(new, low):
            return low
        low = new


def tile_links(x: np.ndarray, y: np.ndarray | None, threshold: float):
    """Pairs (rows of x, rows of y) with cosine >= threshold; y None: pairs i < j within x."""
    self_tile = y is None
    y = x if self_tile else y
    nx, ny = (v / np.sqrt((v * v).sum(axis=1))[:, None] for v in (x, y))
    (qx, sx, ex), (qy, sy, ey) = quantise(nx), quantise(ny)
    fy = qy.astype(np.float32).T  # |q.q'| <= 127^2 * dim < 2^24 up to 1040 dimensions: exact in float32
    if x.shape[1] > 1040:
        fy = qy.astype(np.float64).T
    found_a, found_b = [], []
    for lo in range(0, len(x), _STRIP):
        hi = min(lo + _STRIP, len(x))
        approx = qx[lo:hi].astype(fy.dtype) @ fy
        # a bound for the whole row first: one cheap comparison for almost all pairs
        least = threshold - _SLACK - ex[lo:hi] - (1.0 + ex[lo:hi]) * ey.max()
        least = np.minimum(least / (sx[lo:hi] * sy.max()), least / (sx[lo:hi] * sy.min())) - 1.0
        a, b = np.nonzero(approx >= least.astype(fy.dtype)[:, None])
        upper = approx[a, b].astype(np.float64)
        a += lo
        upper = upper * sx[a] * sy[b] + ex[a] + (1.0 + ex[a]) * ey[b]
        keep = upper >= threshold - _SLACK
        if self_tile:
            keep &= a < b
        a, b = a[keep], b[keep]
        for i in range(0, len(a), 65_536):
            p, q = a[i : i + 65_536], b[i : i + 65_536]
            exact = np.einsum("ij,ij->i", nx[p], ny[q]) >= threshold
            found_a.append(p[exact])
            found_b.append(q[exact])
    join = lambda parts: np.concatenate(parts) if parts else np.empty(0, np.int64)
    return join(found_a), join(found_b)


def _tile_rows(ids: np.ndarray, mult: np.ndarray, vecs: np.ndarray, sides: np.ndarray, threshold: float):
    """One tile -> arrays (u, v, n): forest links u-v with n null, link counts u with v null."""
    left, right = np.nonzero(sides != 1)[0], np.nonzero(sides != 0)[0]
    if sides[0] == 2:  # a block with itself
        a, b = tile_links(vecs, None, threshold)
    elif len(left) and len(right):
        a, b = tile_links(vecs[left], vecs[right], threshold)
        a, b = left[a], right[b]
    else:
        return None
    if not len(a):
        return None
    n = np.bincount(a, mult[b], len(ids)) + np.bincount(b, mult[a], len(ids))
    root = _roots(len(ids), a, b)
    linked = np.nonzero(root != np.arange(len(ids)))[0]
    some = np.nonzero(n)[0]
    u = np.concatenate([ids[linked], ids[some]])
    v = pa.array(np.concatenate([ids[root[linked]], np.zeros(len(some), np.int64)]), pa.int64(), mask=np.arange(len(u)) >= len(linked))
    c = np.concatenate([np.zeros(len(linked), np.int64), n[some].astype(np.int64)])
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), v, pa.array(c, pa.int64())], ["u", "v", "n"])


def _products(cells: DataFrame, threshold: float) -> DataFrame:
    def run(batches):
        key, parts = None, []

        def done():
            if not parts:
                return None
            ids, mult, side = (np.concatenate([p[i] for p in parts]) for i in range(3))
            vecs = np.concatenate([p[3] for p in parts])
            return _tile_rows(ids, mult, vecs, side, threshold)

        for b in batches:
            i, j, rep, mult, side = (b.column(k).to_numpy(zero_copy_only=False) for k in range(5))
            raw = b.column(5)
            cuts = np.flatnonzero((np.diff(i) != 0) | (np.diff(j) != 0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(i)]):
                if lo == hi:
                    continue
                if (i[lo], j[lo]) != key:
                    out = done()
                    if out is not None:
                        yield out
                    key, parts = (i[lo], j[lo]), []
                flat = raw.slice(lo, hi - lo).flatten().to_numpy(zero_copy_only=False)
                parts.append((rep[lo:hi], mult[lo:hi], side[lo:hi], flat.reshape(hi - lo, -1)))
        out = done()
        if out is not None:
            yield out

    return cells.repartition("i", "j").sortWithinPartitions("i", "j").mapInArrow(run, "u long, v long, n long")


def near_duplicates(
    vectors: DataFrame, vec_col: str = "embedding", id_col: str = "vec_id", threshold: float = THRESHOLD, block: int = BLOCK
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``vectors``.

    n_links counts the other rows linked directly (cosine >= threshold in double
    precision; equal copies included); component_id is the smallest vec_id
    reachable. Vectors that are null, empty, zero or hold null or non-finite components
    link with nothing, nor do vectors of different lengths with each other. A
    repeated vec_id is a vector of its own in each row. Rows with a null vec_id link with nothing and have a null component. Extra columns are ignored.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("x"))
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    # scaled by the largest component first, so that no norm over- or underflows; -0.0 becomes 0.0
    top = F.array_max(F.transform("x", F.abs))
    usable = F.coalesce(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0) & finite & (top > 0), F.lit(False))
    rows = rows.withColumn("x", F.when(usable, F.transform("x", lambda c: c / top + F.lit(0.0))))
    # equal after division by the largest component: parallel, cosine 1
    rows = materialise(rows.withColumn("h", F.when(F.col("x").isNotNull(), F.xxhash64("x"))), "rows")
    good = rows.where("x is not null")
    same = good.groupBy("h", "x").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("mult"))
    # a distinct vector's number is written with it, so every later step sees the same one
    distinct = materialise(same.withColumn("key", F.monotonically_increasing_id()), "distinct")
    blocks = max(1, -(-distinct.count() // block))
    named = distinct.withColumn("own", F.expr(f"int(pmod(xxhash64(key), {blocks}))"))
    cells = (
        named.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        .withColumn("dim", F.size("x"))
        .select(
            (F.least("own", "other") + F.lit(0)).alias("i"),
            (F.greatest("own", "other") + F.col("dim").cast("long") * blocks).alias("j"),
            "key",
            "mult",
            F.expr("case when own = other then 2 when own < other then 0 else 1 end").cast("int").alias("side"),
            "x",
        )
    )
    found = materialise(_products(cells, threshold), "tiles")
    comp = connected_components(found.where("v is not null").select("u", "v")).withColumnRenamed("node", "key")
    counts = found.where("v is null").groupBy(F.col("u").alias("key")).agg(F.sum("n").alias("n"))
    full = distinct.join(counts, "key", "left").join(comp, "key", "left")
    full = materialise(full.withColumn("component", F.coalesce("component", "key")), "full")
    smallest = materialise(full.groupBy("component").agg(F.min("rep").alias("component_id")), "smallest")
    by_rep = materialise(
        full.join(smallest, "component").select(
            "h", F.col("x").alias("x2"), "mult", F.coalesce("n", F.lit(0)).alias("n"), "component_id"
        ),
        "by_rep",
    )
    out = rows.join(by_rep.withColumnRenamed("h", "h2"), (F.col("h") == F.col("h2")) & (F.col("x") == F.col("x2")), "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    return out.select(
        "vec_id",
        F.coalesce(F.col("n") + F.col("mult") - 1, F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
