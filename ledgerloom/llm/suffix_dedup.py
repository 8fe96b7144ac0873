"""Removal of long repeated byte strings with sharded suffix arrays."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.shared import counted, mix, powers, staged

#: Length of an anchor: the string whose equality brings two places into one shard.
ANCHOR = 100
#: Contexts a shard is cut for.
SHARD_CONTEXTS = 1024
_STEP = 1 << 20
_PLACE = np.uint64((1 << 21) - 1)
#: Texts handled at a time inside a task.
_ROWS = 500


def _sums(b: np.ndarray) -> np.ndarray:
    out = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * powers(len(b))[0], out=out[1:])
    return out


def _hashes(sums: np.ndarray, starts, ends) -> np.ndarray:
    return mix((sums[ends] - sums[starts]) * powers(len(sums))[1][starts])


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every window of ``width`` values."""
    n = len(x)
    rows = np.full(-(-n // width) * width, 2**64 - 1, np.uint64)
    rows[:n] = x
    rows = rows.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()[:n]
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()[:n]
    return np.minimum(back[: n - width + 1], ahead[width - 1 :])


def anchors(data: bytes, width: int) -> tuple[np.ndarray, ...]:
    """First and last window start, string hash and context hash of each anchor of a text.

    Every window of ``width`` bytes has one anchor, chosen by its bytes alone: of the ANCHOR-byte
    strings in it the one with the least hash, the leftmost of equals. An anchor's context is all
    bytes of its windows, which are neighbours.
    """
    n, out = len(data), []
    for at in range(0, n - width + 1, _STEP):
        b = np.frombuffer(data[at : min(n, at + _STEP - 1 + width)], np.uint8)
        sums = _sums(b)
        i = np.arange(len(b) - ANCHOR + 1)
        hashes = _hashes(sums, i, i + ANCHOR)
        ordered = (hashes & ~_PLACE) | i.astype(np.uint64)
        owner = (_sliding_min(ordered, width - ANCHOR + 1) & _PLACE).astype(np.int64)
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        last = np.append(first[1:], len(owner)) - 1
        own = owner[first]
        # The same bytes around another place in them are another context.
        shape = ((last - first) << 32 | (own - first)).astype(np.uint64)
        out.append((first + at, last + at, hashes[own], mix(_hashes(sums, first, last + width) + shape)))
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _anchor_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                found = [anchors(x.as_py() or b"", width) for x in part.column("data")]
                rows = pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found]))
                flat = [np.concatenate(c).view(np.int64) for c in zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(rows), part.column("mark").take(rows), *map(pa.array, flat)],
                    ["doc_id", "mark", "start", "stop", "key", "ctx"],
                )

    return run


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes in the order of their first ``depth`` bytes at least (Larsson and Sadakane).

    They start sorted by 8 bytes; the sorted depth doubles per round and only groups
    that still hold several suffixes are sorted again, by the ranks of what follows.
    """
    n = len(text)
    words = eight(text)[:n]
    order = np.argsort(words)
    ranks = np.zeros(n + 1, np.uint64)
    heads = np.ones(n, bool)
    words = words[order]
    heads[1:] = words[1:] != words[:-1]
    first = np.maximum.accumulate(np.where(heads, np.arange(n), 0))
    ranks[order] = first + 1
    h = 8
    while h < min(depth, n):
        last = np.ones(n, bool)
        last[:-1] = heads[1:]
        places = np.flatnonzero(~(heads & last))
        if not len(places):
            break
        group = order[places]
        keys = (ranks[group] << np.uint64(32)) | ranks[np.minimum(group + h, n)]
        sub = np.argsort(keys)
        order[places] = group[sub]
        keys = keys[sub]
        fresh = np.ones(len(places), bool)
        fresh[1:] = keys[1:] != keys[:-1]
        heads[places] = fresh
        first = np.maximum.accumulate(np.where(fresh, places, 0))
        ranks[order[places]] = first + 1
        h *= 2
    return order


def eight(text: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as one number, zeros past the end."""
    n = len(text)
    padded = np.zeros(n + 8, np.uint64)
    padded[:n] = text
    out = np.zeros(n + 1, np.uint64)
    for k in range(8):
        out |= padded[k : k + n + 1] << np.uint64(56 - 8 * k)
    return out


def common_prefixes(text: np.ndarray, order: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int) -> np.ndarray:
    """By place: bytes a suffix shares with the one before it in ``order``, ``most`` at most.

    Kasai's recurrence (one place further on, at most one byte less) runs for all stretches
    ``starts[k]`` to ``ends[k]`` side by side; ``order`` holds the places of these stretches. Since ``order`` may be sorted
    to a limited depth and leave places out, what a place takes over is checked by hashes.
    """
    n = len(text)
    padded = np.concatenate((text, np.zeros(most + 8, np.uint8)))
    words, sums = eight(padded), _sums(padded)
    down = powers(len(sums))[1]
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    out = np.zeros(n, np.int32)
    carry = np.zeros(len(starts), np.int64)
    for step in range(int((ends - starts).max(initial=0))):
        lanes = np.flatnonzero(starts + step < ends)
        i = starts[lanes] + step
        j = before[i]
        h = np.maximum(carry[lanes] - 1, 0)
        same = (sums[i + h] - sums[i]) * down[i] == (sums[j + h] - sums[j]) * down[j]
        h[~same | (j < 0)] = 0
        going = np.flatnonzero((j >= 0) & (h < most))
        while len(going):
            differ = words[i[going] + h[going]] ^ words[j[going] + h[going]]
            more = np.full(len(going), 8)
            some = differ != 0
            # A float's exponent gives the highest set bit; clearing the next bit keeps it from rounding up.
            top = differ[some] & ~(differ[some] >> np.uint64(1))
            more[some] = (1086 - (top.astype(np.float64).view(np.int64) >> 52)) >> 3
            h[going] += more
            going = going[(more == 8) & (h[going] < most)]
        h = np.minimum(h, most)
        out[i] = h
        carry[lanes] = h
    return out


def _layout(rows: pd.DataFrame):
    data = [bytes(x) for x in rows["bytes"]]
    text = np.frombuffer(b"".join(data), np.uint8)
    starts = np.concatenate(([0], np.cumsum([len(x) for x in data]))).astype(np.int64)
    ids = rows.groupby(["doc_id", "mark"], dropna=False, sort=False).ngroup().to_numpy()
    owner = np.repeat(np.arange(len(data)), np.diff(starts))
    offset = np.arange(len(text)) - starts[owner]
    absolute = (ids.astype(np.int64)[owner] << 40) | (rows["start"].to_numpy(np.int64)[owner] + offset)
    return text, starts, owner, offset, absolute


def _searcher(width: int, shared: bool):
    """Repeats inside one shard; with ``shared`` also its distinct windows' fingerprints."""

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates(["key", "ctx"]).reset_index(drop=True)
        text, starts, owner, offset, absolute = _layout(rows)
        ends = starts[1:] - width + 1  # of the windows
        order = suffix_array(text, width)
        order = order[order < ends[owner[order]]]
        lcp = common_prefixes(text, order, starts[:-1], ends, width)[order]
        run = np.flatnonzero(lcp < width)
        least, most = np.minimum.reduceat(absolute[order], run), np.maximum.reduceat(absolute[order], run)
        which = np.cumsum(lcp < width) - 1
        hit = order[(least < most)[which]]
        first = np.full(len(rows), np.iinfo(np.int64).max)
        last = np.full(len(rows), -1)
        np.minimum.at(first, owner[hit], offset[hit])
        np.maximum.at(last, owner[hit], offset[hit])
        out = rows[["key", "ctx"]].assign(first=first, last=last, part=None, prints=None)
        out = out[out["last"] >= 0]
        if shared:
            at = order[run]
            prints = np.sort(_hashes(_sums(text), at, at + width).view(np.int64))
            # Dealt over as many parts of the fingerprint space as the key has shards.
            part = np.mod(prints, rows["shards"][0])
            names = np.unique(part)
            extra = pd.DataFrame({"key": rows["key"][0], "ctx": 0, "first": 0, "last": -1, "part": names})
            extra["prints"] = [prints[part == p] for p in names]
            out = pd.concat([out, extra], ignore_index=True)
        return out

    return search


def _merge(rows: pd.DataFrame) -> pd.DataFrame:
    """Fingerprints that two shards of a key have, by binary search in their merged lists."""
    lists = [np.unique(np.asarray(x, np.int64)) for x in rows["prints"]]
    merged = np.sort(np.concatenate(lists))
    found = [
        x[np.searchsorted(merged, x, "right") - np.searchsorted(merged, x, "left") > 1] for x in lists
    ]
    return pd.DataFrame({"key": rows["key"], "salt": rows["salt"], "prints": found})


def _across(large: DataFrame, width: int, result: str, search) -> DataFrame:
    """Repeats of anchors that are dealt over several shards."""
    local = staged(large.groupBy("key", "salt").applyInPandas(search, result + ", salt long"), "local")
    hits = local.where("last >= 0").select("key", "ctx", "first", "last")
    dealt = local.where("prints IS NOT NULL").select("key", "salt", "part", "prints")
    common = dealt.groupBy("key", "part").applyInPandas(_merge, "key long, salt long, prints array<long>")
    across = (
        large.groupBy("key", "salt")
        .cogroup(common.groupBy("key", "salt"))
        .applyInPandas(_locate(width), "key long, ctx long, first long, last long")
    )
    return (
        hits.unionByName(across)
        .groupBy("key", "ctx")
        .agg(F.min("first").alias("first"), F.max("last").alias("last"))
    )


def _locate(width: int):
    def locate(rows: pd.DataFrame, prints: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(prints):
            return pd.DataFrame({"key": [], "ctx": [], "first": [], "last": []}, dtype="int64")
        sought = np.unique(np.concatenate([np.asarray(x, np.int64) for x in prints["prints"]]))
        out = []
        for key, ctx, data in zip(rows["key"], rows["ctx"], rows["bytes"], strict=True):
            b = np.frombuffer(bytes(data), np.uint8)
            at = np.arange(len(b) - width + 1)
            own = _hashes(_sums(b), at, at + width).view(np.int64)
            place = np.minimum(np.searchsorted(sought, own), max(len(sought) - 1, 0))
            hit = np.flatnonzero(sought[place] == own) if len(sought) else at[:0]
            if len(hit):
                out.append((key, ctx, hit[0], hit[-1]))
        return pd.DataFrame(out, columns=["key", "ctx", "first", "last"], dtype="int64")

    return locate


def repeated_spans(docs: DataFrame, width: int = 400, shard_contexts: int = SHARD_CONTEXTS) -> DataFrame:
    """``doc_id, mark, spans`` of the rows of ``docs`` (``doc_id``, binary ``data``, ``mark`` = its hash)
    that hold a ``width``-byte string which also starts elsewhere; spans cover those strings.

    Equal strings share an anchor, so only places whose anchor occurs twice are looked at, and
    equal contexts of an anchor stand for one another: those that occur twice repeat whole.
    The other contexts of an anchor meet in a shard, where a suffix array and its common prefixes
    show the repeats. An anchor with more contexts than a shard holds is dealt over shards by document;
    these exchange sorted fingerprints of their distinct windows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = staged(
        docs.select("doc_id", "mark", "data").mapInArrow(
            _anchor_rows(width), f"doc_id {kind}, mark long, start long, stop long, key long, ctx long"
        ),
        "anchors",
    )
    contexts = found.groupBy("key", "ctx").agg(
        F.count("*").alias("n"), F.min(F.struct("doc_id", "mark", "start", "stop")).alias("rep")
    )
    by_key = contexts.groupBy("key").agg(F.sum("n").alias("places"), F.count("*").alias("kinds"))
    contexts = staged(contexts.join(by_key.where("places > 1"), "key"), "contexts")
    sought = contexts.where("kinds > 1").select("key", "ctx", "kinds", "rep.*")
    n = sought.count()
    spots = sought.select(
        "doc_id", "mark",
        F.struct("key", "ctx", "kinds", "start", (F.col("stop") + width).alias("stop")).alias("spot"),
    )
    spots = staged(spots.groupBy("doc_id", "mark").agg(F.collect_list("spot").alias("spots")), "spots")
    spots = spots.toDF("s_id", "s_mark", "spots")
    shards = -(-max(n, 1) // shard_contexts)
    cuts = staged(
        docs.join(counted(spots, n), F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("mark") == F.col("s_mark")))
        .select(
            "doc_id", "mark",
            F.explode_outer(
                F.transform(
                    "spots",
                    lambda s: F.struct(
                        s["key"].alias("key"), s["ctx"].alias("ctx"), s["kinds"].alias("kinds"), s["start"].alias("start"),
                        F.substring(F.col("data"), s["start"].cast("int") + 1, (s["stop"] - s["start"]).cast("int")).alias("bytes"),
                    ),
                )
            ).alias("c"),
        )
        .select("doc_id", "mark", "c.*")
        .withColumn("shards", F.ceil(F.col("kinds") / shard_contexts))
        .withColumn("salt", F.pmod(F.xxhash64("doc_id", "mark"), "shards"))
        .withColumn("bin", F.pmod(F.xxhash64("key"), F.lit(shards))),
        "cuts",
    )
    fields = ["doc_id", "mark", "key", "ctx", "start", "bytes"]
    result = "key long, ctx long, first long, last long, part long, prints array<long>"
    small = cuts.where(F.col("kinds") <= shard_contexts).select("bin", *fields).groupBy("bin")
    large = cuts.where(F.col("kinds") > shard_contexts).select("salt", "shards", *fields)

    def with_salt(key, rows):
        return _searcher(width, True)(rows).assign(salt=key[1])

    hits = staged(small.applyInPandas(_searcher(width, False), result).drop("part", "prints"), "hits")
    if not large.isEmpty():
        hits = hits.unionByName(_across(large, width, result, with_salt))
    twice = contexts.where("n > 1").select("key", "ctx", F.lit(-1).alias("first"), F.lit(-1).alias("last"))
    once = contexts.where("n = 1").select("key", "ctx").join(hits, ["key", "ctx"])
    repeats = staged(once.unionByName(twice), "repeats")
    spans = found.join(repeats, ["key", "ctx"]).select(
        "doc_id", "mark",
        F.struct(
            (F.col("start") + F.greatest(F.col("first"), F.lit(0))).alias("start"),
            (F.when(F.col("last") < 0, F.col("stop")).otherwise(F.col("start") + F.col("last")) + width).alias("stop"),
        ).alias("span"),
    )
    return spans.groupBy("doc_id", "mark").agg(F.collect_set("span").alias("spans"))


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for data, spans in zip(batch.column("data"), batch.column("spans"), strict=True):
            data, runs = data.as_py() or b"", []
            for start, stop in sorted((s["start"], s["stop"]) for s in spans.as_py() or ()):
                if runs and start <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], stop)
                else:
                    runs.append([start, stop])
            edges = [0, *(e for r in runs for e in r), len(data)]
            kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            out.append((len(data), len(data) - len(kept), len(runs), kept, hashlib.sha256(kept).hexdigest()))
        cols = list(zip(*out, strict=True)) if out else [()] * 5
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"],
        )


def remove_repeats(docs: DataFrame, width: int = 400, shard_contexts: int = SHARD_CONTEXTS) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept, kept_sha256`` per row of ``docs`` (``doc_id, text``).

    ``kept`` holds the text's bytes without those covered by a ``width``-byte string that also
    starts elsewhere, in another text or the same, before anything is removed. Null is an empty
    text; rows without id and repeated rows are texts like any other; other columns are ignored.
    """
    docs = docs.select("doc_id", F.col("text").cast("binary").alias("data"))
    docs = docs.withColumn("mark", F.xxhash64("data"))
    spans = repeated_spans(docs, width, shard_contexts).toDF("s_id", "s_mark", "spans")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return (
        docs.join(spans, F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("mark") == F.col("s_mark")), "left")
        .select("doc_id", "data", "spans")
        .mapInArrow(
            _remove,
            f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string",
        )
    )
