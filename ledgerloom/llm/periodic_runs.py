"""Periodic runs of words by maximal pairs over an LCP-interval tree."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.shared import WORD

#: A run has at least LEAST words and POWER periods.
LEAST, POWER = 6, 4
#: A match at distance d must have (POWER - 1) * d words, and this many to make a run at all.
_SEED = LEAST - 1
#: Words of texts that are handled together; a longer text is handled alone.
BATCH_WORDS = 200_000
_SEGMENT = 1 << 20
_GAPS = (b" ", b"\n", b"\t", b"\r", b"\v", b"\f")
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def word_numbers() -> dict[bytes, int]:
    """A vocabulary: numbers a word when it is first looked up."""
    return defaultdict(count().__next__)


def word_codes(data: bytes, vocabulary: dict[bytes, int]) -> np.ndarray:
    """Each word as its number in ``vocabulary``, which grows; the text is split a segment at a time."""
    out, at = [], 0
    while at < len(data):
        cut = len(data)
        if cut - at > _SEGMENT:
            cut = max(data.rfind(g, at, at + _SEGMENT) for g in _GAPS)
            if cut <= at:
                cut = min((x for g in _GAPS if (x := data.find(g, at + 1)) > 0), default=len(data))
        out.append(np.array([*map(vocabulary.__getitem__, data[at:cut].split())], np.int64))
        at = cut
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _regrouped(order: np.ndarray, keys: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of ``order`` (sorted by ``keys``): where its group begins; and which groups hold several."""
    fresh = np.ones(len(order), bool)
    fresh[1:] = keys[1:] != keys[:-1]
    heads = np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
    alone = fresh.copy()
    alone[:-1] &= fresh[1:]
    return base[heads], ~alone


def suffix_order(codes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """All suffixes by owner and words, and per k the ranks of their first 2**k words.

    Suffixes end with their text. Each round sorts only those whose first words others share;
    two have equal ranks of level k exactly if their first 2**k words are equal.
    """
    n = len(codes)
    keys = owner * np.int64(codes.max(initial=0) + 1) + codes
    order = np.argsort(keys, kind="stable")
    ranks = np.empty(n, np.int64)
    ranks[order], several = _regrouped(order, keys[order], np.arange(n))
    levels, places, width = [ranks], np.flatnonzero(several), 1
    while len(places):
        group = order[places]
        after = group + width
        inside = after < n
        inside[inside] = owner[after[inside]] == owner[group[inside]]
        following = np.zeros(len(group), np.int64)
        following[inside] = ranks[after[inside]] + 1
        keys = ranks[group] * np.int64(n + 1) + following
        sub = np.argsort(keys, kind="stable")
        order[places] = group = group[sub]
        fresh, several = _regrouped(group, keys[sub], places)
        ranks = ranks.copy()
        ranks[group] = fresh
        places = places[several]
        width *= 2
        if len(places):
            levels.append(ranks)
    return order, levels


def common_words(i: np.ndarray, j: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Words that the suffixes ``i`` and ``j`` have in common, from the ranks of ``suffix_order``."""
    n = len(levels[0])
    out = np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        a, b = i + out, j + out
        inside = np.flatnonzero((a < n) & (b < n))
        same = levels[k][a[inside]] == levels[k][b[inside]]
        out[inside[same]] += 1 << k
    return out


def _candidates(order: np.ndarray, levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes that can be in a pair, in order, and what each shares with the one before.

    A partner stands no nearer than the nearest place with the same words, so a suffix whose longest match
    is shorter than POWER - 1 times that distance has none.
    """
    lcp = np.zeros(len(order) + 1, np.int64)
    lcp[1:-1] = common_words(order[:-1], order[1:], levels)
    longest = np.maximum(lcp[:-1], lcp[1:])
    kept = np.flatnonzero(longest >= _SEED)
    if not len(kept):
        return order[:0], lcp[:0]
    ranks = levels[min(2, len(levels) - 1)]  # of four words
    places = np.sort(order[kept])
    places = places[np.argsort(ranks[places], kind="stable")]
    gap = np.full(len(places) + 1, len(order), np.int64)
    same = ranks[places[1:]] == ranks[places[:-1]]
    gap[1:-1][same] = (places[1:] - places[:-1])[same]
    nearest = np.full(len(order), len(order), np.int64)
    nearest[places] = np.minimum(gap[:-1], gap[1:])
    kept = kept[longest[kept] >= (POWER - 1) * nearest[order[kept]]]
    if not len(kept):
        return order[:0], lcp[:0]
    shared = np.minimum.reduceat(lcp[: kept[-1] + 1], np.append(0, kept[:-1] + 1))  # least of all between two kept ones
    shared[0] = 0
    return order[kept], shared


class _Interval:
    """An LCP interval: its places in order, and one list of places per word before them."""

    __slots__ = ("classes", "places")

    def __init__(self, place: int, left: int):
        self.places = [place]
        self.classes = {left: [place]}


def _added(into: list[int], places: list[int]) -> None:
    if len(places) < 8:
        for p in places:
            insort(into, p)
    else:
        into.extend(places)
        into.sort()


def _joined(a: _Interval, b: _Interval, depth: int, before: dict[int, int], found: dict) -> _Interval:
    """Two children of an interval of ``depth`` common words as one; their maximal pairs go to ``found``.

    Places of different children differ in the word after the match, those of different lists in the word before:
    such a pair is maximal, and with a distance of ``depth`` / (POWER - 1) at most it spans a run.
    All places so near to one another lie in one run of the shortest period; there every place but the run's first
    has the same word before it. So the lists of the outermost two places in reach are all that need a look.
    """
    if len(a.places) < len(b.places):
        a, b = b, a
    reach = depth // (POWER - 1)
    for left, members in b.classes.items():
        for x in members:
            low, high = bisect_left(a.places, x - reach), bisect_right(a.places, x + reach)
            if low == high:
                continue
            for other in {before[a.places[low]], before[a.places[high - 1]]}:
                if other == left:
                    continue
                near = a.classes[other]
                for y in near[bisect_left(near, x - reach) : bisect_right(near, x + reach)]:
                    start, period = (x, y - x) if x < y else (y, x - y)
                    if period + depth >= LEAST:
                        # Multiples of a period span the same run; the shortest counts.
                        span = (start, period + depth)
                        found[span] = min(period, found.get(span, period))
    _added(a.places, b.places)
    for left, members in b.classes.items():
        own = a.classes.get(left)
        if own is None:
            a.classes[left] = members
        else:
            _added(own, members)
    return a


def maximal_pairs(order: np.ndarray, lcp: np.ndarray, left: np.ndarray) -> dict[tuple[int, int], int]:
    """(start, length) -> period of all runs, from the LCP-interval tree, bottom up.

    ``order`` holds suffixes, ``lcp`` what each shares with the one before, ``left`` numbers the word before each.
    """
    found: dict = {}
    before = dict(zip(order.tolist(), left.tolist(), strict=True))
    stack: list[tuple[int, _Interval]] = []
    child = None
    for place, depth in zip([*order.tolist(), -1], [*lcp.tolist(), 0], strict=True):
        if child is not None:
            if depth < _SEED:
                depth = 0
            while stack and depth < stack[-1][0]:
                top, node = stack.pop()
                child = _joined(node, child, top, before, found)
            if stack and depth == stack[-1][0]:
                stack[-1] = (depth, _joined(stack[-1][1], child, depth, before, found))
            elif depth:
                stack.append((depth, child))
        if place >= 0:
            child = _Interval(place, before[place])
    return found


def runs_of(texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of all runs of each text, by start and period; a text is an array of word numbers."""
    sizes = np.array([len(t) for t in texts], np.int64)
    first = np.concatenate(([0], np.cumsum(sizes)))
    out: list[list] = [[] for _ in texts]
    if not first[-1]:
        return out
    codes = np.concatenate(texts)
    owner = np.repeat(np.arange(len(texts)), sizes)
    order, lcp = _candidates(*suffix_order(codes, owner))
    # No word stands before a text: a class of its own.
    begins = order == first[owner[order]]
    left = np.where(begins, -1 - owner[order], codes[order - 1])
    for (start, length), period in maximal_pairs(order, lcp, left).items():
        text = int(owner[start])
        out[text].append((start - int(first[text]), length, period))
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Places of the words outside every run but for its first period."""
    if not runs:
        return np.arange(n)
    edges = np.zeros(n + 1, np.int64)
    start, length, period = np.array(runs, np.int64).T
    np.add.at(edges, start + period, 1)
    np.add.at(edges, start + length, -1)
    return np.flatnonzero(np.cumsum(edges)[:n] == 0)


def _result(ids: pa.Array, texts: list[np.ndarray], vocabulary: dict[bytes, int]) -> pa.RecordBatch:
    names, runs = list(vocabulary), runs_of(texts)
    kept = [codes[kept_words(len(codes), found)] for codes, found in zip(texts, runs, strict=True)]
    named = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in found] for found in runs]
    columns = [
        ids, pa.array([len(t) for t in texts], pa.int64()), pa.array(named, pa.list_(_RUN)),
        pa.array([b" ".join(map(names.__getitem__, codes.tolist())) for codes in kept], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])


def _detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, at, held = batch.column("doc_id"), 0, 0
        vocabulary = word_numbers()
        texts: list[np.ndarray] = []
        for k, data in enumerate(batch.column("data")):
            texts.append(word_codes(data.as_py() or b"", vocabulary))
            held += len(texts[-1])
            if held >= BATCH_WORDS or k + 1 == batch.num_rows:
                yield _result(ids.slice(at, len(texts)), texts, vocabulary)
                at, held, vocabulary, texts = k + 1, 0, word_numbers(), []


def periodic_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` per row of ``docs`` (``doc_id``, ``text``).

    ``runs`` are all stretches of consecutive words (``start, length, period``, words counted from 0) with smallest period q and
    ``length >= max(6, 4 * q)`` that no neighbouring word extends, by start and period. ``collapsed`` holds the words that no
    run repeats, i.e. without those inside a run after its first q words, joined by single blanks (binary, UTF-8).

    Words are compared whole, by numbers given within a task. Null, empty and blank texts have no words and no runs. Rows
    are independent: repeated rows and rows without id are texts like any other; other columns are ignored. A text is
    one task's work, split into words a segment at a time; time grows with n log n whatever the text repeats.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("data")).mapInArrow(
        _detect, f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary"
    )


def digests(found: DataFrame) -> DataFrame:
    """Counts, longest run and hashes per document, from the columns of :func:`periodic_runs`."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    listed = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("best"),
        F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
    start, length, period = -F.col("best.s"), F.col("best.length"), -F.col("best.p")
    return best.select(
        "doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


def replayed(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` where the end of every tenth text, by crc32 of the id, repeats itself.

    With h the crc32 of the decimal id and g = h div 10, texts with h mod 10 = 0 and n > 0 words have each word i >= a
    replaced by word a + (i - a) mod p, a = g mod n, p = 1 + (n - a) div (3 + g mod 8). Rows without id stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    words = docs.select(
        "doc_id", "text", F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("words"),
        F.floor(h / 10).cast("long").alias("g"),
    )

    def whole(n: Column) -> Column:
        return n.cast("int")

    sized = words.withColumn("n", F.size("words"))
    placed = sized.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    placed = placed.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    turns = F.ceil((F.col("n") - F.col("a")) / F.col("p"))
    period = F.slice("words", whole(F.col("a") + 1), whole(F.col("p")))
    tail = F.slice(F.flatten(F.array_repeat(period, whole(turns))), F.lit(1), whole(F.col("n") - F.col("a")))
    again = F.array_join(F.concat(F.slice("words", F.lit(1), whole(F.col("a"))), tail), " ")
    return placed.select("doc_id", F.when(F.col("n") > 0, again).otherwise(F.col("text")).alias("text"))
