"""Near duplicates among vectors by products of int8 tiles with rigorous error bounds."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.components import components
from ledgerloom.llm.shared import staged

#: Vectors a tile is cut for, and pairs recomputed in double precision at a time.
TILE_ROWS = 1024
_CHUNK = 1 << 15
_TILE = "label {label}, size int, s1 long, s2 long, sub long"
_KEY = ["label", "size", "s1", "s2", "sub"]


def _usable(vector: Column, label: Column, vec_id: Column) -> Column:
    def finite(x):
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))

    return F.coalesce(
        vec_id.isNotNull() & label.isNotNull() & F.forall(vector, finite)
        & F.exists(vector, lambda x: x != 0),
        F.lit(False),
    )


def _packer(kind: str):
    """One row per tile: raw vectors, int8 codes, scales and error norms of the unit vectors."""

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        raw = np.stack(rows["vector"].to_numpy()).astype(kind)
        full = raw.astype(np.float64)
        full /= np.abs(full).max(axis=1, keepdims=True)
        unit = full / np.sqrt((full * full).sum(axis=1))[:, None]
        scale = np.abs(unit).max(axis=1) / 127
        code = np.rint(unit / scale[:, None]).astype(np.int8)
        error = np.sqrt(((unit - code * scale[:, None]) ** 2).sum(axis=1)) * (1 + 1e-9) + 1e-12
        blobs = [raw, code, scale, error, rows["rep"].to_numpy(np.int64), rows["mark"].to_numpy(np.int64)]
        blobs.append(rows["copies"].to_numpy(np.int64))
        return pd.DataFrame([[*key, *[np.ascontiguousarray(b).tobytes() for b in blobs]]])

    return pack


def _exact(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Cosines of the pairs in double precision."""
    out = np.empty(len(i))
    for at in range(0, len(i), _CHUNK):
        u, v = x[i[at : at + _CHUNK]], y[j[at : at + _CHUNK]]
        dot = np.einsum("ij,ij->i", u, v)
        out[at : at + _CHUNK] = dot / np.sqrt(np.einsum("ij,ij->i", u, u) * np.einsum("ij,ij->i", v, v))
    return out


def _forest(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each linked row and column the least row of its component in this tile pair."""
    n = mask.shape[0]
    rows, none = np.arange(n), n
    while True:
        cols = np.where(mask, rows[:, None], none).min(axis=0, initial=none)
        after = np.minimum(rows, np.where(mask, cols[None, :], none).min(axis=1, initial=none))
        if (after == rows).all():
            return rows, cols
        rows = after


def _joiner(kind: str, threshold: float):
    def load(row: dict, side: str):
        size = row["size"]
        get = lambda name, dtype: np.frombuffer(row[f"{side}_{name}"], dtype)
        raw = get("raw", kind).reshape(-1, size).astype(np.float64)
        raw = raw / np.abs(raw).max(axis=1, keepdims=True)
        code = get("code", np.int8).reshape(-1, size)
        return raw, code, *(get(n, np.float64) for n in ("scale", "error")), *(
            get(n, np.int64) for n in ("rep", "mark", "copies")
        )

    def links(row: dict):
        x, qx, sx, ex, rx, mx, wx = load(row, "l")
        y, qy, sy, ey, ry, my, wy = load(row, "r")
        exact = np.float32 if row["size"] <= 1040 else np.float64  # whole numbers below 2**24
        near = (qx.astype(exact) @ qy.astype(exact).T).astype(np.float64) * sx[:, None] * sy[None, :]
        nx, ny = 1 + ex, 1 + ey  # norms of the decoded unit vectors, at most
        near += nx[:, None] * ey[None, :] + ex[:, None] * ny[None, :] + ex[:, None] * ey[None, :]
        maybe = near >= threshold - 1e-9
        if row["same"]:
            maybe = np.triu(maybe, 1)
        i, j = np.nonzero(maybe)
        sure = _exact(x, y, i, j) >= threshold
        mask = np.zeros(maybe.shape, bool)
        mask[i[sure], j[sure]] = True
        if row["same"]:
            mask |= mask.T
        left, right = mask @ wy, mask.T @ wx
        some = np.flatnonzero(left)
        cols = np.flatnonzero(right)
        part = mask[np.ix_(some, cols)]
        up, down = _forest(part)
        out = [(rx[some], mx[some], left[some], rx[some[up]])]
        # In a tile with itself each row is also a column; its links count once.
        n = right[cols] * (not row["same"])
        out.append((ry[cols], my[cols], n, rx[some[down]]))
        return [np.concatenate(z) for z in zip(*out, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in links(row)], ["rep", "mark", "n", "root"]
                )

    return run


def near_dedup(vectors: DataFrame, threshold: float = 0.98, tile_rows: int = TILE_ROWS) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` per row of ``vectors``.

    ``vectors`` has ``vec_id`` long, ``label`` and ``embedding`` (an array of floats or doubles);
    other columns are ignored. Rows of one label and length link when their cosine, in
    double precision, is ``threshold`` or more. A row links with nothing when its id, label
    or vector is null, or its vector is empty, zero, or holds null or non-finite components:
    it has 0 links and itself as component. ``n_links`` counts other rows, equal
    vectors included.

    Equal vectors are one class with a weight. Two linked unit vectors differ by at most
    ``sqrt(2 - 2 * threshold)``, so along any fixed direction too: cutting two directions into
    slabs of that width leaves only neighbouring cells to compare. Cells are split into
    tiles of bounded size, whatever the label's share of the rows, and each pair of tiles is one int8
    matrix product; only pairs whose product plus error bound reaches the threshold are
    recomputed. A tile pair returns link counts and one link to the root of each of its
    components, never its pairs.
    """
    kind = "f4" if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else "f8"
    label = vectors.schema["label"].dataType.simpleString()
    rows = vectors.select("vec_id", "label", "embedding").withColumn(
        "usable", _usable(F.col("embedding"), F.col("label"), F.col("vec_id"))
    )
    rows = rows.withColumn("vector", F.when(F.col("usable"), F.transform("embedding", lambda x: x + F.lit(0.0).cast(x_type(kind)))))
    classes = (
        rows.where("usable")
        .groupBy("label", "vector")
        .agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
        .withColumn("size", F.size("vector"))
        .withColumn("mark", F.xxhash64("vector"))
    )
    width = math.sqrt(max(0.0, 2 - 2 * threshold)) * (1 + 1e-6) + 1e-9
    double = F.transform("vector", lambda x: x.cast("double"))

    def slab(bit: int) -> Column:
        signed = F.aggregate(
            F.transform("unit", lambda x, i: F.when(F.shiftright(i, bit) % 2 == 0, x).otherwise(-x)),
            F.lit(0.0), lambda a, x: a + x,
        )
        return F.floor(signed / F.sqrt("size") / width)

    # Norms are of vectors scaled to a largest component of 1, so squares stay finite.
    classes = classes.withColumn("most", F.array_max(F.transform(double, F.abs)))
    classes = classes.withColumn("unit", F.transform(double, lambda x: x / F.col("most")))
    norm = F.sqrt(F.aggregate("unit", F.lit(0.0), lambda a, x: a + x * x))
    classes = classes.withColumn("norm", norm).withColumn(
        "unit", F.transform("unit", lambda x: x / F.col("norm"))
    )
    classes = staged(
        classes.withColumn("s1", slab(0)).withColumn("s2", slab(1)).drop("unit", "norm", "most"), "classes"
    )
    cells = classes.groupBy("label", "size", "s1", "s2").agg(
        F.ceil(F.count("*") / tile_rows).alias("tiles")
    )
    tiled = classes.join(cells, ["label", "size", "s1", "s2"]).withColumn(
        "sub", F.pmod(F.xxhash64("mark", "rep"), F.col("tiles"))
    )
    blobs = ["raw", "code", "scale", "error", "rep", "mark", "copies"]
    schema = _TILE.format(label=label) + ", " + ", ".join(f"{b} binary" for b in blobs)
    tiles = staged(
        tiled.select(*_KEY, "rep", "mark", "copies", "vector")
        .groupBy(*_KEY)
        .applyInPandas(_packer(kind), schema),
        "tiles",
    )
    keys = tiles.select(_KEY)
    steps = [(0, 0), (0, 1), (1, -1), (1, 0), (1, 1)]
    near = keys.withColumn(
        "step", F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in steps]))
    ).select(
        "label", "size", "s1", "s2", "sub", "step",
        (F.col("s1") + F.col("step.a")).alias("t1"), (F.col("s2") + F.col("step.b")).alias("t2"),
    )
    other = keys.select("label", "size", F.col("s1").alias("t1"), F.col("s2").alias("t2"), F.col("sub").alias("o_sub"))
    own = (F.col("step.a") == 0) & (F.col("step.b") == 0)
    pairs = near.join(other, ["label", "size", "t1", "t2"]).where(~own | (F.col("sub") <= F.col("o_sub")))
    pairs = pairs.withColumn("same", own & (F.col("sub") == F.col("o_sub"))).drop("step")
    left = tiles.select(*_KEY, *[F.col(b).alias(f"l_{b}") for b in blobs])
    right = tiles.select(
        "label", "size", F.col("s1").alias("t1"), F.col("s2").alias("t2"), F.col("sub").alias("o_sub"),
        *[F.col(b).alias(f"r_{b}") for b in blobs],
    )
    found = staged(
        pairs.join(left, _KEY)
        .join(right, ["label", "size", "t1", "t2", "o_sub"])
        .select("size", "same", *[f"{s}_{b}" for s in "lr" for b in blobs])
        .mapInArrow(_joiner(kind, threshold), "rep long, mark long, n long, root long"),
        "links",
    )
    links = found.groupBy("rep", "mark").agg(F.sum("n").alias("linked"))
    reached = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    named = (
        classes.select("label", "vector", "rep", "mark", "copies")
        .join(links, ["rep", "mark"], "left")
        .join(reached.withColumnRenamed("node", "rep"), "rep", "left")
        .select(
            "label", "vector", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "rep").alias("component_id"),
        )
    )
    return (
        rows.join(named, ["label", "vector"], "left")
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component_id", "vec_id").alias("component_id"),
        )
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    )


def x_type(kind: str) -> str:
    return "float" if kind == "f4" else "double"
