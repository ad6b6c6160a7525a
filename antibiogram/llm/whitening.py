"""Whitening of embeddings by a tiled covariance.

Each entry c becomes the whole number floor(scale * c). The fit list holds each distinct vector of numbers once, so copies do
not weigh. Its covariance is made in tiles: a task cuts its rows into row blocks and each of those into blocks of ``tile``
columns; column blocks are shuffled by row block; the task that gets a row block centres its column blocks, multiplies every
pair of them (a tile key) and adds the product to its sum of that tile; the tasks' sums of a tile are added, first in ``WAYS``
groups. A task holds one row block and one sum a tile: 4 * dimension ** 2 bytes and ``BLOCK_BYTES``. The driver gets
numbers by dimension only: the sums, and the tiles that it assembles and decomposes. Rows then meet the components in their
own tasks, without a shuffle.

Sums and deviations are exact whole numbers. Components are those of the largest eigenvalues, their sign such that the entry
of largest size is positive. ``identity_error`` is measured: the whitened fit list's own covariance against the identity.

Edge cases: null vectors and vectors with null or non-finite entries are left out, and so are empty vectors and those of
another length than most distinct vectors have (ties: the longer); scaled entries beyond 64 bits stay at their limits; rows with a
null or repeated id are kept each; where the vectors spread in fewer directions than components are asked for, those left over have a null
``whitened`` (and a null ``explained`` where nothing varies) and ``identity_error`` is of the others (null: there are none);
a deviation of more than 38 digits is null; other columns are not looked at; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table

TILE = 32
#: Numbers of a row block, as doubles.
BLOCK_BYTES = 4 << 20
#: Groups of tasks whose sums of a tile are added first.
WAYS = 64


def whole_numbers(rows: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """(_id, x) of the rows whose vector is whole and finite."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    vectors = rows.select(F.col(id_col).alias("_id"), F.col(vec_col).cast("array<double>").alias("v")).where(F.col("v").isNotNull() & F.coalesce(F.forall("v", finite), F.lit(False)))
    return vectors.select("_id", F.transform("v", lambda c: F.floor(c * scale).cast("long")).alias("x"))


def _matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _total(x: np.ndarray) -> list[int]:
    """Exact sums by column."""
    far = max(abs(int(x.max())), abs(int(x.min()))) if len(x) else 0
    return [int(v) for v in (x if far * len(x) < 1 << 62 else x.astype(object)).sum(axis=0)]


def sums(fit: DataFrame, dim: int) -> list[int]:
    """The sum of each dimension: one row a dimension and task is shuffled, one a dimension reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [0] * dim
        for batch in batches:
            found = [a + b for a, b in zip(found, _total(_matrix(batch, dim)), strict=True)] if batch.num_rows else found
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array([Decimal(v) for v in found], pa.decimal128(38, 0))], ["d", "s"])

    parts = fit.mapInArrow(run, "d int, s decimal(38,0)").groupBy("d").agg(F.sum("s").alias("s"))
    return [int(s) for _, s in sorted(map(tuple, parts.collect()))]


def column_blocks(fit: DataFrame, dim: int, tile: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows (row_block, column_block, kind, data): the whole numbers of a block by rows, in the smallest kind that holds them."""
    block_rows = max(1, block_bytes // (8 * dim))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        task, nth, held, n = TaskContext.get().partitionId(), 0, [], 0

        def blocks() -> pa.RecordBatch:
            x = np.concatenate(held)
            kind = np.result_type(np.min_scalar_type(x.min()), np.min_scalar_type(x.max()))
            kind = np.dtype("i8") if kind.kind != "i" and kind.itemsize == 8 else kind
            cut = [np.ascontiguousarray(x[:, k : k + tile].astype(kind)).tobytes() for k in range(0, dim, tile)]
            ids = pa.array([(task << 32) + nth] * len(cut), pa.int64())
            return pa.RecordBatch.from_arrays([ids, pa.array(range(len(cut)), pa.int32()), pa.array([kind.str] * len(cut)), pa.array(cut, pa.binary())], ["row_block", "column_block", "kind", "data"])

        for batch in batches:
            x = _matrix(batch, dim)
            for k in range(0, len(x), block_rows):
                part = x[k : k + block_rows]
                if n and n + len(part) > block_rows:
                    yield blocks()
                    nth, held, n = nth + 1, [], 0
                held.append(part)
                n += len(part)
        if n:
            yield blocks()

    return fit.mapInArrow(run, "row_block long, column_block int, kind string, data binary")


def tile_sums(blocks: DataFrame, dim: int, tile: int, mean: np.ndarray, parts: int) -> DataFrame:
    """Rows (i, j, data), i <= j: the sum over all rows of column block i's centred numbers times column block j's."""
    widths = [min(tile, dim - k) for k in range(0, dim, tile)]

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[tuple[int, int], np.ndarray] = {}
        own: list[np.ndarray] = []
        for batch in batches:
            for k, kind, data in zip(batch["column_block"], batch["kind"], batch["data"], strict=True):
                x = np.frombuffer(data, kind).reshape(-1, widths[k])
                own.append(x.astype("f8") - mean[k * tile : k * tile + widths[k]])
                if len(own) == len(widths):  # a row block's column blocks come together, in order
                    for i, a in enumerate(own):
                        for j in range(i, len(own)):
                            product = a.T @ own[j]
                            found[i, j] = found[i, j] + product if (i, j) in found else product
                    own = []
        task = TaskContext.get().partitionId()
        yield pd.DataFrame([(i, j, task, x.tobytes()) for (i, j), x in found.items()], columns=["i", "j", "task", "data"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        """At most as many rows as there are tasks, dealt over ``WAYS`` groups."""
        total = 0
        for data in rows.sort_values("task")["data"]:
            total = total + np.frombuffer(data)
        return pd.DataFrame([(rows["i"].iloc[0], rows["j"].iloc[0], rows["task"].min(), total.tobytes())], columns=["i", "j", "task", "data"])

    shape = "i int, j int, task int, data binary"
    products = blocks.repartition(parts, "row_block").sortWithinPartitions("row_block", "column_block").mapInPandas(multiply, shape)
    return products.groupBy("i", "j", F.pmod("task", F.lit(WAYS))).applyInPandas(add, shape).groupBy("i", "j").applyInPandas(add, shape)


def covariance(fit: DataFrame, n: int, dim: int, total: list[int], tile: int = TILE, block_bytes: int = BLOCK_BYTES) -> np.ndarray:
    """The fit list's covariance (divisor n), assembled from its tiles."""
    spark = fit.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tiles = tile_sums(column_blocks(fit, dim, tile, block_bytes), dim, tile, np.array([s / n for s in total]), parts)
    v = np.zeros((dim, dim))
    for i, j, data in tiles.select("i", "j", "data").collect():  # (dim / tile) ** 2 / 2 rows, dim ** 2 numbers
        rows, cols = slice(i * tile, min(dim, (i + 1) * tile)), slice(j * tile, min(dim, (j + 1) * tile))
        v[rows, cols] = np.frombuffer(data).reshape(rows.stop - rows.start, -1)
        v[cols, rows] = v[rows, cols].T
    return v / n


def eigen(v: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit vectors as columns; eigenvalues that are rounding noise are zero."""
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    e = np.where(e > max(e.max(), 0) * len(v) * np.finfo(float).eps, e, 0)
    return e, u * np.sign(u[np.abs(u).argmax(axis=0), np.arange(u.shape[1])])


def _deviations(x: np.ndarray, n: int, total: list[int]) -> pa.Array:
    """Sums over dimensions of (n * x - total) ** 2, exact."""
    far = n * max(abs(int(x.max())), abs(int(x.min()))) + max(map(abs, total)) if len(x) else 0
    if len(total) * far * far < 1 << 63:
        return pa.array(((n * x - np.array(total)) ** 2).sum(axis=1)).cast(pa.decimal128(38, 0))
    wide = ((n * x.astype(object) - np.array(total, object)) ** 2).sum(axis=1)
    return pa.array([Decimal(int(v)) if v < 10**38 else None for v in wide], pa.decimal128(38, 0))


def whiten(
    vectors: DataFrame, components: int = 4, scale: float = 256, id_col: str = "vec_id", vec_col: str = "embedding", tile: int = TILE, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: for each row and component."""
    spark = vectors.sparkSession
    small_batches(spark)
    rows = whole_numbers(vectors, id_col, vec_col, scale).where(F.size("x") > 0)
    kind = rows.schema["_id"].dataType
    out = f"vec_id {kind.simpleString()}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    fit = table(rows.select("x").distinct())
    sizes = fit.groupBy(F.size("x").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    if sizes is None:
        return spark.createDataFrame([], out)
    dim, n = sizes
    fit, rows = fit.where(F.size("x") == dim), rows.where(F.size("x") == dim)
    total = sums(fit, dim)
    v = covariance(fit, n, dim, total, tile, block_bytes)
    e, u = eigen(v, min(components, dim))
    mean, trace, spread = np.array([s / n for s in total]), float(np.trace(v)), e > 0
    axes = u[:, spread] / np.sqrt(e[spread])
    k, m = len(e), int(spread.sum())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = (_matrix(batch, dim) - mean) @ axes
            yield pa.RecordBatch.from_arrays([pa.array(w[:, c]) for c in range(m)], [f"w{c}" for c in range(m)])

    error = None
    if m:
        whitened = fit.mapInArrow(project, ", ".join(f"w{c} double" for c in range(m)))
        got = whitened.agg(*[F.covar_pop(f"w{a}", f"w{b}").alias(f"c{a}_{b}") for a in range(m) for b in range(a, m)]).first()
        error = max(abs(got[f"c{a}_{b}"] - (a == b)) for a in range(m) for b in range(a, m))
    shares = [float(x) / trace if trace > 0 else None for x in e]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, size = _matrix(batch, dim), batch.num_rows
            w = np.full((size, k), np.nan)
            w[:, spread] = (x - mean) @ axes
            each = np.repeat(np.arange(size), k)
            columns = [
                batch.column("_id").take(pa.array(each)),
                pa.array(np.tile(np.arange(1, k + 1, dtype="i4"), size)),
                pa.array(np.full(size * k, n, "i8")),
                _deviations(x, n, total).take(pa.array(each)),
                pa.array(w.ravel(), from_pandas=True),
                pa.array(shares * size, pa.float64()),
                pa.array([error] * (size * k), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, out)
