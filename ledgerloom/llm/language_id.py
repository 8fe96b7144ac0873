"""Language identification by a small convolutional network over bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a window, width of the byte embedding, filter widths and filters of each width.
WINDOW, EMBED, WIDTHS, FILTERS = 128, 8, (2, 3, 4), 16
#: Most labelled texts per language, and windows of each, that training looks at.
TEXTS_PER_LANGUAGE, WINDOWS_PER_TEXT = 400, 4
_SPAN = max(WIDTHS)
_BATCH = 64


@dataclass
class Network:
    languages: list[str]
    embed: np.ndarray  # 256 x EMBED
    filters: np.ndarray  # (_SPAN * EMBED) x (len(WIDTHS) * FILTERS); narrow filters end in zeros
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def pooled(self, windows: np.ndarray, places: bool = False):
        """Largest response of every filter in each window; with ``places`` where it was."""
        e = self.embed[windows]
        n = windows.shape[1] - _SPAN + 1
        cols = np.concatenate([e[:, k : k + n] for k in range(_SPAN)], axis=2)
        reply = (cols.reshape(-1, _SPAN * EMBED) @ self.filters).reshape(len(windows), n, -1)
        if places:
            at = reply.argmax(axis=1)
            return cols, at, np.take_along_axis(reply, at[:, None, :], 1)[:, 0] + self.bias
        return reply.max(axis=1) + self.bias

    def log_odds(self, windows: np.ndarray) -> np.ndarray:
        """Log probabilities of the languages per window."""
        parts = [
            np.maximum(self.pooled(windows[k : k + _BATCH]), 0) @ self.out + self.out_bias
            for k in range(0, len(windows), _BATCH)
        ]
        z = np.concatenate(parts)
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def windows_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All fixed-length windows of a text, zero-padded at the end, and the bytes each holds."""
    n = max(1, -(-len(data) // WINDOW))
    b = np.zeros(n * WINDOW + _SPAN - 1, np.uint8)
    b[: len(data)] = np.frombuffer(data, np.uint8)
    at = np.arange(WINDOW + _SPAN - 1)
    held = np.full(n, WINDOW)
    held[-1] = max(1, len(data) - (n - 1) * WINDOW)
    return b[np.arange(n)[:, None] * WINDOW + at], held


def _mask() -> np.ndarray:
    rows = np.repeat(np.arange(_SPAN), EMBED)[:, None]
    return (rows < np.repeat(WIDTHS, FILTERS)[None, :]).astype(np.float32)


def train(texts: list[tuple[bytes, str]], steps: int = 500, seed: int = 11) -> Network:
    """Fit the network to (text, language) pairs with Adam; the same input gives the same network.

    Without texts it knows no language and calls everything ``und``.
    """
    rng = np.random.default_rng(seed)
    languages = sorted({lang for _, lang in texts})
    x, y = [], []
    for data, lang in texts:
        w = windows_of(data)[0]
        pick = np.unique(np.linspace(0, len(w) - 1, WINDOWS_PER_TEXT).astype(int))
        x.append(w[pick])
        y += [languages.index(lang)] * len(pick)
    mask, units = _mask(), len(WIDTHS) * FILTERS
    net = Network(
        languages,
        rng.normal(0, 0.5, (256, EMBED)).astype(np.float32),
        (rng.normal(0, 0.25, (_SPAN * EMBED, units)) * mask).astype(np.float32),
        np.zeros(units, np.float32),
        rng.normal(0, 0.2, (units, len(languages))).astype(np.float32),
        np.zeros(len(languages), np.float32),
    )
    if not texts:
        return net
    x, y = np.concatenate(x), np.array(y)
    names = ("embed", "filters", "bias", "out", "out_bias")
    moments = {n: [np.zeros_like(getattr(net, n)), np.zeros_like(getattr(net, n))] for n in names}
    by_class = [np.flatnonzero(y == k) for k in range(len(languages))]
    for step in range(1, steps + 1):
        pick = rng.choice(np.concatenate([rng.choice(c, 32) for c in by_class]), _BATCH)
        batch, goal = x[pick], y[pick]
        # Texts may be short: some windows are cut to a random length.
        cut = rng.integers(8, WINDOW, len(batch))
        short = rng.random(len(batch)) < 0.3
        batch = np.where((np.arange(batch.shape[1])[None] >= cut[:, None]) & short[:, None], 0, batch)
        cols, at, top = net.pooled(batch, places=True)
        hidden = np.maximum(top, 0)
        z = hidden @ net.out + net.out_bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(goal)), goal] -= 1
        p /= len(goal)
        back = (p @ net.out.T) * (top > 0)
        seen = cols[np.arange(len(batch))[:, None], at]  # batch x units x (_SPAN * EMBED)
        slope = {
            "out": hidden.T @ p,
            "out_bias": p.sum(axis=0),
            "bias": back.sum(axis=0),
            "filters": np.einsum("bu,bud->du", back, seen) * mask,
        }
        into = (back[:, :, None] * net.filters.T[None]).reshape(len(batch), units, _SPAN, EMBED)
        which = batch[np.arange(len(batch))[:, None, None], at[:, :, None] + np.arange(_SPAN)]
        slope["embed"] = np.zeros_like(net.embed)
        np.add.at(slope["embed"], which, into)
        rate = 0.01 * (1 - step / (steps + 1))
        for name in names:
            m, v = moments[name]
            g = slope[name].astype(np.float32)
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            fixed = (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
            getattr(net, name)[...] -= rate * fixed
    return net


def labelled_sample(docs: DataFrame, keep: Column, per_language: int = TEXTS_PER_LANGUAGE) -> list[tuple[bytes, str]]:
    """Texts and languages to learn from: of the rows that ``keep`` allows, ``per_language``
    of each language at most, in a fixed random order of the ids."""
    ids = docs.where(keep & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = ids.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= per_language)
    chosen = F.broadcast(ids.select("doc_id", F.col("lang").alias("_lang")))  # per_language rows of each
    rows = docs.join(chosen, "doc_id").where(F.col("lang") == F.col("_lang")).select("doc_id", "lang", "text")
    found = rows.orderBy("lang", "doc_id", "text").collect()
    return [(r["text"].encode("utf-8", "replace"), r["lang"]) for r in found]


def _identifier(net: Network, text_column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = [], []
            for value in batch.column(text_column):
                text = value.as_py()
                if not net.languages or text is None or not any(map(str.isalpha, text)):
                    langs.append("und")
                    scores.append(0.0)
                    continue
                windows, held = windows_of(text.encode("utf-8", "replace"))
                sums = np.zeros(len(net.languages))
                for k in range(0, len(windows), 4096):
                    sums += held[k : k + 4096] @ net.log_odds(windows[k : k + 4096]).astype(np.float64)
                p = np.exp((sums - sums.max()) / held.sum())
                best = int(p.argmax())
                langs.append(net.languages[best])
                scores.append(float(p[best] / p.sum()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                [*batch.schema.names, "lang_pred", "lang_score"],
            )

    return run


def identify(docs: DataFrame, net: Network, text_column: str = "text") -> DataFrame:
    """``docs`` plus ``lang_pred`` and ``lang_score`` (0 to 1), which replace columns of these names.

    A text's score is the softmax of its windows' mean log probabilities, weighted by the bytes they
    hold; all windows of the whole text count. Null texts and texts without a letter are ``und``
    with score 0. Other columns pass through; repeated rows get equal results.
    """
    docs = docs.drop("lang_pred", "lang_score")
    extra = [T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())]
    schema = T.StructType([*docs.schema.fields, *extra])
    return docs.mapInArrow(_identifier(net, text_column), schema)
