"""Runs, nearest neighbours and conversation repair against brute force on small awkward tables."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import cross_polytope, periodic_runs, queries, turn_repair

BLANK = re.compile(rb"[\x20\x09-\x0D]+")


# -- runs of words -----------------------------------------------------------------------------------


def brute_runs(words):
    """Every run by comparing words q apart, for each q; multiples of a period span the same run."""
    spans = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            if words[i] == words[i + q]:
                j = i
                while j + q < len(words) and words[j] == words[j + q]:
                    j += 1
                if j - i + q >= max(6, 4 * q):
                    spans.setdefault((i, j - i + q), q)
                i = j
            i += 1
    return sorted(((s, n, q) for (s, n), q in spans.items()), key=lambda r: (r[0], r[2]))


def brute_replayed(doc_id, words):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def brute_digest(doc_id, text):
    words = brute_replayed(doc_id, [w for w in BLANK.split((text or "").encode()) if w])
    runs = brute_runs(words)
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    return (
        doc_id, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2],
        hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
        hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in dropped)).hexdigest(),
    )


def awkward_texts():
    rng = random.Random(5)
    texts = [None, "", " \n\t", "one", "a a a a a", "a a a a a a", "a b a b a b a b", "x " * 3000, "É é É é", "a  b\na\tb a b\va b"]
    for _ in range(150):
        words = [rng.choice("abc") for _ in range(rng.randint(0, 40))]
        period = [rng.choice("ab") for _ in range(rng.randint(1, 5))]
        texts.append(" ".join(words + period * rng.randint(0, 9) + words[:3]))
    texts.append(" ".join(rng.choice("ab") for _ in range(4000)))
    unit = [f"w{k}" for k in range(300)]
    texts.append(" ".join(["intro"] + unit * 4 + unit[:17] + ["end"] + unit))
    return texts


def test_runs_equal_brute_force(spark):
    rows = [(k, t) for k, t in enumerate(awkward_texts())] + [(3, "a a a a a a a"), (None, "b b b b b b b"), (3, "a a a a a a a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n", "'x' AS runs", "2 AS data")
    found = periodic_runs.digests(periodic_runs.periodic_runs(periodic_runs.replayed(docs)))
    want = sorted((brute_digest(*r) for r in rows), key=repr)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == want
    assert sum(r[1] > 0 for r in want) > 30


def test_runs_over_many_batches_and_an_empty_table(spark, monkeypatch):
    rng = np.random.default_rng(1)
    numbered = [rng.integers(0, 2, rng.integers(0, 50)) for _ in range(200)]
    assert periodic_runs.runs_of(numbered) == [brute_runs(list(t)) for t in numbered]
    assert periodic_runs.runs_of([]) == []
    monkeypatch.setattr(periodic_runs, "_SEGMENT", 10)
    words = periodic_runs.word_numbers()
    codes = periodic_runs.word_codes(b"aa bb\ncc  aaaaaaaaaaaaaaaaaaaaaaaa bb cc ", words)
    assert [list(words)[c] for c in codes] == [b"aa", b"bb", b"cc", b"a" * 24, b"bb", b"cc"]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert periodic_runs.digests(periodic_runs.periodic_runs(periodic_runs.replayed(empty))).collect() == []


@pytest.mark.parametrize("words", [np.zeros(60_000, int), np.resize(np.arange(7), 60_000), np.resize(np.arange(15_000), 60_000)])
def test_one_run_over_a_long_text_is_found_quickly(words):
    period = len(set(words.tolist()))
    assert periodic_runs.runs_of([words.astype(np.int64)]) == [[(0, 60_000, period)]]


# -- nearest neighbours ---------------------------------------------------------------------------------


def brute_nearest(rows, count):
    """(query_id, rank, vec_id, score) by comparing every pair of sound rows."""
    sound = [
        (i, v) for i, v in rows
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(x != 0 for x in v)
    ]
    out = []
    for k, (i, v) in enumerate(sound):
        if i % 20 == 0:
            scored = [(-sum(a * b for a, b in zip(v, w, strict=True)), j) for m, (j, w) in enumerate(sound) if m != k and len(w) == len(v)]
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(sorted(scored)[:count], 1)]
    return out


def vectors(spark, rows, kind="double"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").selectExpr("*", "1 AS rank", "2 AS mark", "'x' AS data")


def found_nearest(df, count):
    got = cross_polytope.nearest(df, F.col("vec_id") % 20 == 0, count)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(tuple(r) for r in got.collect())


def test_nearest_with_copies_ties_unsound_rows_and_few_candidates(spark):
    rng = np.random.default_rng(2)
    rows = [(k, [float(x) for x in rng.integers(-3, 4, 6)]) for k in range(60)]
    rows += [(100 + k, [1.0, 2.0, 0.0, 0.0, 0.0, 1.0]) for k in range(90)]  # copies, queries among them
    rows += [(200, None), (220, [0.0] * 6), (240, [1.0, None] * 3), (260, [math.nan] * 6), (280, [math.inf] + [1.0] * 5), (None, [1.0] * 6)]
    rows += [(300, [1.0, 2.0]), (301, [2.0, 1.0]), (320, [5.0]), (340, []), (40, rows[40][1]), (400, [1e3, 0.0, 0.0, 0.0, 0.0, -1e-3])]
    got = found_nearest(vectors(spark, rows), 7)
    assert got == sorted(brute_nearest(rows, 7))


def test_recall_against_brute_force_and_exact_scores(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 64))
    x[1000:2000] = x[0] + 0.05 * rng.normal(size=(1000, 64))  # a third are near copies
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(x)]
    got = found_nearest(vectors(spark, rows, "float"), 20)
    doubled = x.astype(np.float64)
    near = defaultdict(set)
    for q, rank, j, score in got:
        near[q].add(j)
        assert q != j and 1 <= rank <= 20 and score == pytest.approx(doubled[q] @ doubled[j], abs=1e-12)
    assert set(near) == set(range(0, 3000, 20)) and all(len(v) == 20 for v in near.values())
    hits = 0
    for q, own in near.items():
        s = doubled @ doubled[q]
        s[q] = -np.inf
        hits += len(own & set(np.argsort(-s)[:20].tolist()))
    assert hits >= 0.95 * 20 * len(near)


def test_nearest_of_nothing(spark):
    assert found_nearest(vectors(spark, []), 20) == []
    assert found_nearest(vectors(spark, [(1, [1.0, 2.0])]), 20) == []
    assert found_nearest(vectors(spark, [(0, [1.0, 2.0])]), 20) == []


def test_rotation_keeps_products():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(5, 50))
    for turn in cross_polytope.signs(50, 3):
        y = cross_polytope.rotated(x, turn)
        assert np.allclose(y @ y.T, x @ x.T)
        assert (cross_polytope.probes(y)[:, 0] == cross_polytope.axes(y)).all()


# -- conversation repair -----------------------------------------------------------------------------------


def legal(state, initial):
    return ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})[state].get(initial)


def brute_repair(rows):
    """(cost, audit, repaired) by trying every edit: the least (cost, letters) per state, row by row."""

    def inserted(ways):
        for _ in range(4):
            for s, (cost, letters, out) in list(ways.items()):
                for role in ("user", "assistant"):
                    z = legal(s, role[0])
                    new = (cost + 3, letters + "I", [*out, f"{role}:"])
                    if z is not None and (z not in ways or new[:2] < ways[z][:2]):
                        ways[z] = new
        return ways

    ways = {0: (0, "", [])}
    for role, text, fault in rows:
        after = {}
        for s, (cost, letters, out) in inserted(ways).items():
            options = [(4, "D", s, out)]
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                options.append((more, "K", legal(s, role[:1]), [*out, f"{role}:{text}"]))
                options += [(more + 3, "R", legal(s, r[0]), [*out, f"{r}:{text}"]) for r in ("user", "assistant")]
            for c, x, z, o in options:
                if z is not None and (z not in after or (cost + c, letters + x) < after[z][:2]):
                    after[z] = (cost + c, letters + x, o)
        ways = after
    return min((w for s, w in inserted(ways).items() if s in (0, 3)), key=lambda w: w[:2])


def brute_damage(rows):
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k == 1:
            text = ""
        if k == 2:
            text = re.sub("[.!?]", "", text)
        if k == 4:
            role = "user"
        yield from [(conv, turn, role, text)] * (0 if k == 0 else 2 if k == 3 else 1)


def brute_conversations(rows):
    out = {r[0]: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) for r in rows}
    groups = defaultdict(list)
    for conv, turn, role, text in brute_damage(rows):
        groups[conv].append((turn, role, text))
    for conv, turns in groups.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:64], hashlib.md5(r[2].encode()).hexdigest()))
        seen, faults, judged = set(), defaultdict(int), []
        for _, role, text in turns:
            bare = text.rstrip(" \t\n\v\f\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            faults[fault] += 1
            judged.append((role, text, fault))
        told = [t for t, _, _ in turns if t is not None]
        pairs = zip([r[:1] for _, r, _ in turns], [r[:1] for _, r, _ in turns[1:]], strict=False)
        cost, audit, repaired = brute_repair(judged)
        out[conv] = (
            max(told) - min(told) + 1 - len(set(told)) if told else 0, faults["blank"], faults["duplicate"], faults["truncated"],
            sum("".join(p) not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(repaired).encode()).hexdigest(),
        )
    return sorted(((k, *v) for k, v in out.items()), key=repr)


def awkward_conversations():
    rng = random.Random(6)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "uncle", "User"], ["Hi.", "Yes!", "no", "", " \t", None, "Why?\n", "ü."]
    rows = []
    for conv in [*range(1, 120), None, -7]:
        for turn in range(rng.randint(1, 9)):
            rows.append((conv, rng.choice([turn, turn, turn, None, 2]), rng.choice(roles[: rng.choice([2, 3, 8])]), rng.choice(texts)))
    rows += [(500, k, ("user", "assistant")[k % 2], f"Part {k // 7}.") for k in range(300)]
    rows += [(501, k, "assistant", f"{k}.") for k in range(90)]
    return rows


def repaired(spark, rows, tmp_path):
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").selectExpr(
        "*", "1 AS at", "'x' AS code", "2 AS chunk"
    ).write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
    df = queries.op13_turn_repair(spark, str(tmp_path))
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted((tuple(r) for r in df.select(names).collect()), key=repr)


@pytest.mark.parametrize("bits", [12, 1])
def test_repairs_equal_brute_force(spark, tmp_path, monkeypatch, bits):
    monkeypatch.setattr(turn_repair, "CHUNK_BITS", bits)
    rows = awkward_conversations()
    assert repaired(spark, rows, tmp_path) == brute_conversations(rows)


def test_conversations_without_rows_left(spark, tmp_path):
    gone = [c for c in range(3000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][:3]
    rows = [(c, 0, "user", "Hi.") for c in gone]
    assert repaired(spark, rows, tmp_path) == brute_conversations(rows)
    assert repaired(spark, [], tmp_path) == []


def test_crossings_of_chunks_equal_one_sweep():
    rng = random.Random(7)
    for _ in range(300):
        codes = [rng.randrange(4) + 4 * rng.choice([0, 0, 1, 2, 3]) for _ in range(rng.randint(1, 20))]
        cost, end = turn_repair.best_end([turn_repair.row_step(c) for c in codes])
        parts = [codes[k : k + 3] for k in range(0, len(codes), 3)]
        steps = [turn_repair.summary(p) for p in parts]
        assert turn_repair.best_end(steps) == (cost, end)
        split = [x for p, b in zip(parts, turn_repair.crossings(steps, 0, end), strict=True) for x in turn_repair.crossings(p, *b)]
        assert split == turn_repair.crossings(codes, 0, end)
