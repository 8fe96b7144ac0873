"""Nearest neighbours by inner product with cross-polytope hashing and multiprobe tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.shared import staged

NEIGHBOURS = 20
#: Share of true neighbours that tables and probes must find for the sample of queries.
RECALL = 0.98
#: Queries that tables and probes are fitted on, those with the least hash; all vectors are compared with them.
SAMPLE_QUERIES = 128
#: Tables at most, and probes per table that are tried; all axes of one table are an exhaustive search.
TABLES, PROBES = 32, (1, 2, 4, 8, 16, 32)
#: Products that cost as much as copying a vector through a shuffle.
COPY = 1000
#: Rows and queries of a tile, and tables that are searched in one round.
TILE, ROUND = 1024, 4
_TURNS = 3
_SEED = 20


def signs(size: int, tables: int = TABLES) -> np.ndarray:
    """Random signs of each table's pseudo-rotation for vectors of a length."""
    padded = 1 << max(1, (size - 1).bit_length())
    return np.random.default_rng((_SEED, size)).choice([-1.0, 1.0], (tables, _TURNS, padded))


def rotated(x: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Each row after one table's pseudo-rotation: thrice random signs, then a fast Hadamard transform."""
    padded = turn.shape[1]
    y = np.zeros((len(x), padded))
    y[:, : x.shape[1]] = x
    for sign in turn:
        y *= sign
        width = 1
        while width < padded:
            pairs = y.reshape(len(y), -1, 2, width)
            y = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), 2).reshape(len(y), padded)
            width *= 2
        y /= np.sqrt(padded)
    return y


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def axes(y: np.ndarray) -> np.ndarray:
    """The signed axis nearest to each rotated vector: twice the axis, plus 1 for its negative side."""
    axis = np.abs(y).argmax(axis=1)
    return 2 * axis + (y[np.arange(len(y)), axis] < 0)


def probes(y: np.ndarray) -> np.ndarray:
    """All signed axes for each rotated query, nearest first."""
    both = np.stack((y, -y), axis=2).reshape(len(y), -1)
    return np.argsort(-both, axis=1, kind="stable")


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, summed from the first component on, so equal pairs have equal scores."""
    out = np.zeros(len(x))
    for k in range(x.shape[1]):
        out += x[:, k] * y[:, k]
    return out


def _nearest(q: np.ndarray, x: np.ndarray, floor: np.ndarray, count: int):
    """(query, row, score) of the ``count`` largest products per query, ties and last-place doubts included."""
    with np.errstate(over="ignore", invalid="ignore"):
        score = q @ x.T
    slack = 1e-12 * np.sqrt((q * q).sum(axis=1)) * np.sqrt((x * x).sum(axis=1).max())
    least = floor.copy()
    if score.shape[1] > count:
        least = np.maximum(least, np.partition(score, -count, axis=1)[:, -count])
    i, j = np.nonzero(~(score < (least - slack)[:, None]))
    return i, j, products(q[i], x[j])


def _usable(vector: Column, vec_id: Column) -> Column:
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vec_id.isNotNull() & sound & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, size)


def _hashed(tables: int):
    """Adds the bucket of each row in each table; ``data`` holds the vectors as doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("size").to_numpy(zero_copy_only=False)
            buckets = np.zeros((batch.num_rows, tables), np.int32)
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                x = unit(_matrix(batch.column("data").take(pa.array(at)), int(size)))
                for t, turn in enumerate(signs(int(size), tables)):
                    buckets[at, t] = axes(rotated(x, turn))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(buckets.tolist(), pa.list_(pa.int32()))], [*batch.schema.names, "buckets"]
            )

    return run


def _bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``vector`` as the bytes of its doubles."""
    for batch in batches:
        data = [np.asarray(v, np.float64).tobytes() for v in batch.column("vector").to_pylist()]
        names = [n for n in batch.schema.names if n != "vector"]
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(data, pa.binary())], [*names, "data"])


def _sample_search(queries: list[tuple[int, bytes]], count: int):
    """Per batch the nearest rows of each sampled query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("size").to_numpy(zero_copy_only=False)
            out = []
            for size in np.unique(sizes):
                own = [(n, np.frombuffer(d, np.float64)) for n, d in queries if len(d) == 8 * size]
                if not own:
                    continue
                at = np.flatnonzero(sizes == size)
                x = _matrix(batch.column("data").take(pa.array(at)), int(size))
                q = np.stack([v for _, v in own])
                i, j, score = _nearest(q, x, np.full(len(q), -np.inf), count)
                out.append((np.array([n for n, _ in own])[i], at[j], score))
            if out:
                n, row, score = (np.concatenate(c) for c in zip(*out, strict=True))
                columns = [pa.array(n.astype(np.int64)), pa.array(score), batch.column("data").take(pa.array(row))]
                yield pa.RecordBatch.from_arrays(columns, ["n", "score", "data"])

    return run


def fitted(rows: DataFrame, queries: DataFrame, count: int, recall: float = RECALL) -> tuple[int, int]:
    """(tables, probes per table) of least work that find ``recall`` of the sample's true neighbours.

    ``SAMPLE_QUERIES`` queries are compared with every row; their neighbours, ``count`` per query, come to the driver.
    A table copies every row and a probe every query; a copy counts as ``COPY`` products. Only where no choice finds
    enough, as in a table of a few rows, every axis of one table is probed, which finds everything.
    """
    sizes = rows.count(), queries.count()
    sample = queries.orderBy(F.xxhash64("data"), "data").limit(SAMPLE_QUERIES).select("data").collect()
    sample = [(n, bytes(r["data"])) for n, r in enumerate(sample)]
    near = rows.select("size", "data").mapInArrow(_sample_search(sample, count), "n long, score double, data binary")
    top = Window.partitionBy("n").orderBy(F.desc("score"), "data")
    found = near.withColumn("place", F.row_number().over(top)).where(F.col("place") <= count).collect()
    ranks = []
    for n, data in sample:
        own = [np.frombuffer(r["data"], np.float64) for r in found if r["n"] == n]
        if own:
            q, x = np.frombuffer(data, np.float64)[None], np.stack(own)
            rank = np.empty((len(own), TABLES), np.int64)
            for t, turn in enumerate(signs(q.shape[1])):
                place = np.argsort(probes(rotated(unit(q), turn))[0])
                rank[:, t] = place[axes(rotated(unit(x), turn))]
            ranks.append(rank)
    if not ranks:
        return 1, 2
    ranks = np.concatenate(ranks)
    every = 2 * max(signs(len(d) // 8, 1).shape[2] for _, d in sample)
    choices = []
    for p in (p for p in PROBES if p < every):
        hit = np.logical_or.accumulate(ranks < p, axis=1).mean(axis=0)
        enough = np.flatnonzero(hit >= recall)
        if len(enough):
            work = COPY * (sizes[0] + p * sizes[1]) + p * sizes[0] * sizes[1] / every
            choices.append(((int(enough[0]) + 1) * work, int(enough[0]) + 1, p))
    return min(choices)[1:] if choices else (1, every)


def _probed(tables: int, first: int, last: int, count: int):
    """The buckets of each query in the tables ``first`` to ``last - 1``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("size").to_numpy(zero_copy_only=False)
            out: list = [None] * batch.num_rows
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                x = unit(_matrix(batch.column("data").take(pa.array(at)), int(size)))
                near = [probes(rotated(x, turn))[:, :count] for turn in signs(int(size), tables)[first:last]]
                for k, row in enumerate(at):
                    out[row] = [{"t": first + t, "b": int(b)} for t, n in enumerate(near) for b in n[k]]
            kind = pa.list_(pa.struct([("t", pa.int32()), ("b", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, kind)], [*batch.schema.names, "probed"])

    return run


_KEY = ["size", "t", "b"]
_ROW = "vec_id long, mark long, nth int"


def _pack(fields: list[str]):
    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        blobs = [b"".join(rows["data"])] + [np.ascontiguousarray(rows[f].to_numpy()).tobytes() for f in fields]
        return pd.DataFrame([[*key, *blobs]])

    return pack


def _tiles(rows: DataFrame, fields: list[str], part: str) -> tuple[DataFrame, DataFrame]:
    """Rows of a bucket packed by pieces of about ``TILE``, one row per piece; and the number of pieces per bucket."""
    pieces = rows.groupBy(*_KEY).agg(F.ceil(F.count("*") / TILE).cast("int").alias("pieces"))
    dealt = rows.join(pieces, _KEY).withColumn(part, F.pmod(F.xxhash64(*fields), F.col("pieces")).cast("int"))
    key = [*_KEY, part]
    schema = ", ".join(f"{k} int" for k in key) + ", data binary, " + ", ".join(f"{f} binary" for f in fields)
    return dealt.select(*key, "data", *fields).repartition(*key).groupBy(*key).applyInPandas(_pack(fields), schema), pieces


def _searched(count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                get = lambda name, kind: np.frombuffer(row[name], kind)  # noqa: B023, E731
                q, x = (get(n, np.float64).reshape(-1, row["size"]) for n in ("q_data", "data"))
                i, j, score = _nearest(q, x, get("floor", np.float64), count)
                columns = [get("q", np.int64)[i], get("q_mark", np.int64)[i]]
                columns += [get("vec_id", np.int64)[j], get("mark", np.int64)[j], get("nth", np.int32)[j], score]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in columns], ["q", "q_mark", "vec_id", "mark", "nth", "score"]
                )

    return run


def _round(rows: DataFrame, queries: DataFrame, count: int) -> DataFrame:
    """``q, q_mark, vec_id, mark, nth, score``: the nearest of each query in each tile it probes."""
    right, right_pieces = _tiles(rows, ["vec_id", "mark", "nth"], "piece")
    left, _ = _tiles(queries, ["q", "q_mark", "floor"], "block")
    left = left.withColumnRenamed("data", "q_data")
    # The blocks of queries go to each piece of their bucket, so a full bucket is as many keys as it has pieces.
    spread = left.join(right_pieces, _KEY).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    met = spread.drop("pieces", "block").join(right, [*_KEY, "piece"])
    return met.select("size", "q_data", "q", "q_mark", "floor", "data", "vec_id", "mark", "nth").mapInArrow(
        _searched(count), f"q long, q_mark long, {_ROW}, score double"
    )


def _best(found: DataFrame, count: int) -> DataFrame:
    """The ``count`` nearest of what was found per query; a row found in several tables counts once."""
    once = found.groupBy("q", "q_mark", "vec_id", "mark", "nth").agg(F.max("score").alias("score"))
    order = Window.partitionBy("q", "q_mark").orderBy(F.desc("score"), "vec_id", "mark", "nth")
    return once.withColumn("place", F.row_number().over(order)).where(F.col("place") <= count).drop("place")


def nearest(vectors: DataFrame, is_query: Column, count: int = NEIGHBOURS, recall: float = RECALL) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``count`` nearest other rows of each row of ``vectors`` for which ``is_query``.

    ``vectors`` has ``vec_id`` (an integer) and ``embedding`` (floats or doubles); other columns are ignored. Nearness is the
    largest inner product in double precision of the vectors as they are; equal scores go by ``vec_id``. Rows without id, and vectors
    that are null, empty, zero or hold null or non-finite components, take no part; vectors of another length
    are no candidates. A repeated row is a candidate of its copies. With fewer candidates than ``count`` all are returned.

    Each table turns all vectors by a fast pseudo-rotation and files them under the nearest signed axis of their
    direction; a query looks under the axes nearest to its own. How many tables and probes that takes is fitted
    (:func:`fitted`); queries that come out short look under all axes of one table. Equal vectors are looked for once;
    as candidates the first ``count + 1`` of them by id are all that can be in an answer. Buckets are compared in
    tiles of bounded size; a bucket with many near copies costs its queries times its rows, in as many tasks as it has pieces.
    Tables are searched in rounds, each of which returns only what can enter a query's best so far.
    """
    kind = vectors.schema["vec_id"].dataType
    rows = vectors.withColumn("_query", F.coalesce(is_query, F.lit(False)))
    rows = rows.where(_usable(F.col("embedding"), F.col("vec_id"))).select(
        F.col("vec_id").cast("long").alias("vec_id"), "_query", F.size("embedding").alias("size"), F.col("embedding").alias("vector")
    )
    rows = rows.withColumn("vector", F.transform("vector", lambda x: x.cast("double") + 0.0))  # no negative zero
    rows = staged(
        rows.mapInArrow(_bytes, "vec_id long, _query boolean, size int, data binary").withColumn("mark", F.xxhash64("data")),
        "vectors",
    )
    asked = rows.where("_query")
    copies = Window.partitionBy("size", "data").orderBy("vec_id")
    index = rows.withColumn("nth", F.row_number().over(copies)).where(F.col("nth") <= count + 1).drop("_query")
    queries = asked.groupBy("size", "data", "mark").agg(F.min("vec_id").alias("q")).withColumnRenamed("mark", "q_mark")
    queries = staged(queries.withColumn("floor", F.lit(float("-inf"))), "queries")
    index = staged(index, "index")
    tables, probed = fitted(index, queries, count + 1, recall)
    index = staged(
        index.mapInArrow(_hashed(tables), "vec_id long, size int, data binary, mark long, nth int, buckets array<int>"), "hashed"
    )

    def search(asking: DataFrame, first: int, last: int, width: int) -> DataFrame:
        schema = "size int, data binary, q_mark long, q long, floor double, probed array<struct<t:int,b:int>>"
        looked = asking.select("size", "data", "q_mark", "q", "floor").mapInArrow(_probed(tables, first, last, width), schema)
        looked = looked.select("size", "data", "q_mark", "q", "floor", F.explode("probed").alias("p")).select("*", "p.t", "p.b")
        filed = index.select("*", F.posexplode(F.slice("buckets", first + 1, last - first)).alias("k", "b"))
        filed = filed.withColumn("t", F.col("k") + first)
        return _round(filed, looked, count + 1)

    best = None
    for first in range(0, tables, ROUND):
        found = search(queries, first, min(tables, first + ROUND), probed)
        best = staged(_best(found if best is None else best.union(found), count + 1), "best")
        had = best.groupBy("q", "q_mark").agg(F.count("*").alias("n"), F.min("score").alias("least"))
        floor = F.when(F.col("n") > count, F.col("least")).otherwise(float("-inf"))
        queries = staged(queries.drop("floor", "n").join(had, ["q", "q_mark"], "left").withColumn("floor", floor).drop("least"), "asked")
    short = queries.where(F.coalesce("n", F.lit(0)) <= count)
    if not short.isEmpty():
        every = 1 << 30  # more than any table has axes
        best = staged(_best(best.union(search(short, 0, 1, every)), count + 1), "best")
    near = F.struct((-F.col("score")).alias("minus"), F.col("vec_id").alias("near_id"), F.col("mark").alias("near_mark"), "nth", "score")
    lists = best.groupBy("q", "q_mark").agg(F.array_sort(F.collect_list(near)).alias("near"))
    named = queries.select("q", "q_mark", "data").join(lists, ["q", "q_mark"])
    # A row is not its own candidate: one entry of its id and vector goes.
    joined = asked.select("vec_id", "data").join(named, "data")
    own = F.array_position(F.transform("near", lambda n: (n["near_id"] == F.col("vec_id")) & (n["near_mark"] == F.col("q_mark"))), F.lit(True))
    others = F.slice(F.filter("near", lambda n, k: k + 1 != F.col("own")), 1, count)
    ranked = joined.withColumn("own", own).select("vec_id", F.posexplode(others).alias("k", "n"))
    return ranked.select(
        F.col("vec_id").cast(kind).alias("query_id"), (F.col("k") + 1).cast("int").alias("rank"),
        F.col("n.near_id").cast(kind).alias("vec_id"), F.col("n.score").alias("score"),
    )
