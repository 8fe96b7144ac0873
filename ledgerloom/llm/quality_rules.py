"""Quality scores from a sparse ensemble of rules over text statistics."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.shared import BREAK, counted, total

#: Labelled texts that training looks at, at most; trees, their depth, and rules that may stay.
SAMPLE_ROWS, TREES, DEPTH, MOST_RULES = 8_000, 40, 3, 60

STATISTICS = [
    "log_chars", "log_words", "letters", "upper", "digits", "marks", "pipes", "word_length", "longest_word",
    "distinct_words", "distinct_lines", "line_length", "bang_words", "marked_words", "capital_words",
]

Rule = tuple[tuple[int, float, bool], ...]


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus a double column ``q_<name>`` for each of STATISTICS; a null text counts as empty.

    Every statistic is taken over the whole text and is 0 where it would divide by 0.
    """

    def share(a, b):
        return F.coalesce(a / F.when(b > 0, b), F.lit(0.0))

    def size_without(pattern: str) -> Column:
        return F.length(F.regexp_replace("_text", pattern, ""))

    words = F.filter(F.split("_text", BREAK), lambda w: w != "")
    row = F.struct(*docs.columns).alias("_row")  # packed, so that no name can clash
    parts = docs.select(row, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    parts = parts.withColumn("_words", words).withColumn("_lines", F.split("_text", "\n"))
    counts = parts.select(
        "_row",
        F.length("_text").cast("double").alias("_chars"),
        F.size("_words").cast("double").alias("_n"),
        size_without(r"\p{L}+").alias("_no_letter"),
        size_without(r"\p{Lu}+").alias("_no_upper"),
        size_without("[0-9]+").alias("_no_digit"),
        size_without(r"[\x20\x09-\x0D]+").alias("_no_gap"),
        F.length(F.translate("_text", "|", "")).alias("_no_pipe"),
        F.aggregate("_words", F.lit(0), lambda a, w: F.greatest(a, F.length(w))).alias("_longest"),
        F.size(F.array_distinct("_words")).alias("_kinds"),
        F.size("_lines").alias("_n_lines"),
        F.size(F.array_distinct("_lines")).alias("_line_kinds"),
        F.regexp_count("_text", F.lit(r"[!?]{2,}")).alias("_bangs"),
        F.regexp_count("_text", F.lit(r"[^\p{L}\p{N}\x20\x09-\x0D.,;:!?'\"()-]{2,}")).alias("_marked"),
        F.regexp_count("_text", F.lit(r"(?<!\p{L})\p{Lu}{3,}(?!\p{L})")).alias("_capital"),
    )
    c = {x: F.col(f"_{x}").cast("double") for x in (
        "chars", "n", "no_letter", "no_upper", "no_digit", "no_gap", "no_pipe", "longest", "kinds", "n_lines",
        "line_kinds", "bangs", "marked", "capital",
    )}
    letters = c["chars"] - c["no_letter"]
    values = [
        F.log1p(c["chars"]), F.log1p(c["n"]), share(letters, c["chars"]), share(c["chars"] - c["no_upper"], letters),
        share(c["chars"] - c["no_digit"], c["chars"]),
        share(c["no_letter"] + c["no_gap"] + c["no_digit"] - 2 * c["chars"], c["chars"]),
        share(c["chars"] - c["no_pipe"], c["n"]), share(c["no_gap"], c["n"]), c["longest"], share(c["kinds"], c["n"]),
        share(c["line_kinds"], c["n_lines"]), share(c["chars"], c["n_lines"]), share(c["bangs"], c["n"]),
        share(c["marked"], c["n"]), share(c["capital"], c["n"]),
    ]
    named = [v.alias(f"q_{name}") for v, name in zip(values, STATISTICS, strict=True)]
    return counts.select("_row.*", *named)


@dataclass
class RuleModel:
    rules: list[Rule]
    weights: list[float]
    intercept: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        return rule_matrix(self.rules, x)

    def score(self) -> Column:
        """The model as a column expression over the statistics."""
        terms = [F.lit(self.intercept)]
        for rule, weight in zip(self.rules, self.weights, strict=True):
            held = F.lit(True)
            for feature, cut, below in rule:
                c = F.col(f"q_{STATISTICS[feature]}")
                held = held & ((c <= cut) if below else (c > cut))
            terms.append(F.when(held, weight).otherwise(0.0))
        return 1 / (1 + F.exp(-total(terms)))


def rule_matrix(rules: list[Rule], x: np.ndarray) -> np.ndarray:
    out = np.ones((len(x), len(rules)))
    for k, rule in enumerate(rules):
        for feature, cut, below in rule:
            out[:, k] *= (x[:, feature] <= cut) == below
    return out


def _grow(x, slope, cuts, columns, depth, path, rules) -> np.ndarray:
    """A small regression tree; adds the path to each of its nodes to ``rules``."""
    value = np.full(len(x), slope.mean() if len(x) else 0.0)
    best = (1e-9, None)
    if depth and len(x) >= 40:
        sum_, n = slope.sum(), len(slope)
        for f in columns:
            bins = np.searchsorted(cuts[f], x[:, f], side="left")
            left_n = np.cumsum(np.bincount(bins, minlength=len(cuts[f]) + 1))[:-1]
            left = np.cumsum(np.bincount(bins, weights=slope, minlength=len(cuts[f]) + 1))[:-1]
            fine = (left_n >= 20) & (n - left_n >= 20)
            if fine.any():
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(fine, left**2 / left_n + (sum_ - left) ** 2 / (n - left_n) - sum_**2 / n, 0)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], (f, float(cuts[f][k])))
    if best[1]:
        f, cut = best[1]
        below = x[:, f] <= cut
        for side in (True, False):
            step = (*path, (f, cut, side))
            rules.append(step)
            part = below == side
            value[part] = _grow(x[part], slope[part], cuts, columns, depth - 1, step, rules)
    return value


def _tidy(rule: Rule) -> Rule:
    """Conditions in a fixed order, of two on one side of a feature the tighter one."""
    tight: dict[tuple[int, bool], float] = {}
    for f, cut, below in rule:
        old = tight.get((f, below), cut)
        tight[(f, below)] = min(old, cut) if below else max(old, cut)
    return tuple(sorted((f, cut, below) for (f, below), cut in tight.items()))


def fit(x: np.ndarray, y: np.ndarray, seed: int = 5) -> RuleModel:
    """Rules from the paths of boosted small trees, weighted by a lasso logistic regression."""
    base = math.log((y.sum() + 1) / (len(y) - y.sum() + 1)) if len(y) else 0.0
    if len(y) < 80 or y.min() == y.max():
        return RuleModel([], [], base)
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0.02, 0.98, 33))) for f in range(x.shape[1])]
    margin, rules = np.full(len(y), base), []
    for _ in range(TREES):
        part = rng.random(len(y)) < 0.5
        columns = rng.choice(x.shape[1], max(2, x.shape[1] // 2), replace=False)
        slope = y - 1 / (1 + np.exp(-margin))
        found: list[Rule] = []
        _grow(x[part], slope[part], cuts, columns, DEPTH, (), found)
        rules += found
        for rule in found:  # the step of each path's end, shrunk
            held = rule_matrix([rule], x)[:, 0] > 0
            if len(rule) == DEPTH and held.any():
                margin[held] += 0.6 * slope[held].mean() / max(1e-2, (slope[held] ** 2).mean() ** 0.5)
    rules = sorted({_tidy(r) for r in rules})
    m = rule_matrix(rules, x)
    some = (m.mean(axis=0) > 0.005) & (m.mean(axis=0) < 0.995)
    rules, m = [r for r, s in zip(rules, some, strict=True) if s], m[:, some]
    penalty = 0.001
    while True:
        weights, intercept = _lasso(m, y, penalty)
        kept = np.flatnonzero(weights)
        if len(kept) <= MOST_RULES:
            return RuleModel([rules[k] for k in kept], [float(weights[k]) for k in kept], float(intercept))
        penalty *= 1.5


def _lasso(m: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression with an L1 penalty by accelerated proximal gradient steps."""
    scale = np.maximum(m.std(axis=0), 1e-6)
    z = (m - m.mean(axis=0)) / scale
    step = 4 * len(y) / max(np.linalg.norm(z, 2) ** 2 + len(y), 1.0)
    w, b = np.zeros(z.shape[1]), math.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    ahead, ahead_b, t = w.copy(), b, 1.0
    for _ in range(rounds):
        r = 1 / (1 + np.exp(-(z @ ahead + ahead_b))) - y
        new = ahead - step * (z.T @ r) / len(y)
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        new_b = ahead_b - step * r.mean()
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        ahead, ahead_b = new + (t - 1) / t2 * (new - w), new_b + (t - 1) / t2 * (new_b - b)
        w, b, t = new, new_b, t2
    return w / scale, b - float((w * m.mean(axis=0) / scale).sum())


def train(docs: DataFrame, labels: DataFrame, keep: Column, rows: int = SAMPLE_ROWS) -> RuleModel:
    """Fit to ``labels`` (``doc_id, quality``) of the documents that ``keep`` allows.

    At most ``rows`` labels are used, in a fixed random order of the ids; a document with both labels
    counts as bad. Too few labels, or one kind only, give a constant score.
    """
    ids = (
        labels.where(keep & F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("_quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    texts = docs.select("doc_id", "text").join(counted(ids, rows), "doc_id")
    names = [f"q_{s}" for s in STATISTICS]
    found = with_statistics(texts).select("doc_id", "_quality", *names).limit(2 * rows).collect()
    found.sort(key=lambda r: tuple(r))
    x = np.array([[r[n] for n in names] for r in found]).reshape(-1, len(names))
    return fit(x, np.array([float(r["_quality"] == 1) for r in found]))


def score(docs: DataFrame, model: RuleModel) -> DataFrame:
    """``docs`` plus ``quality_score`` (0 to 1), which replaces a column of that name.

    Null and empty texts get the score of their statistics, which are all 0.
    """
    docs = docs.drop("quality_score", *[f"q_{name}" for name in STATISTICS])
    return with_statistics(docs).select(*docs.columns, model.score().alias("quality_score"))
