"""The declarative resolve job against a small sequential model, plus merge cases."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import resolve as R
from ledgerloom.operators.normalise import normalise
from ledgerloom.schemas import PARSED_SCHEMA

DAY = dt.datetime(2026, 9, 17)


def parsed_row(seq, **kw):
    base = {
        "seq": seq, "amount_minor": 54000, "currency_code": "INR", "type": "DEBIT",
        "txn_ts": DAY, "description": None, "merchant_name": "Swiggy",
        "reference_number": None, "account_identifier": "XX1234", "bank_name": None,
        "payment_method": "UNKNOWN", "source": "CSV", "source_identifier": None,
        "origin_label": "f", "parse_status": "PARSED", "raw_payload": None,
        "is_promotional": False,
    }
    base.update(kw)
    return tuple(base.values())


def frame(spark, rows):
    return spark.createDataFrame(rows, PARSED_SCHEMA)


# --- sequential model ---------------------------------------------------------


class Model:
    """One row at a time against mutable state, for comparison only."""

    def __init__(self):
        self.txns, self.by_id, self.out = [], {}, {}

    def add(self, r):
        self.out[r["seq"]] = self._add(r)

    def _add(self, r):
        if r["parse_status"] == "FAILED" and r["amount_minor"] == 0:
            return "FAILED"
        key = (r["source"], r["source_identifier"])
        if key[1] is not None and key in self.by_id:
            t = self.by_id[key]
            if t["is_promotional"] == r["is_promotional"]:
                return "DUPLICATE_SKIPPED"
            t["is_promotional"] = r["is_promotional"]
            return "MERGED"
        same = next((t for t in self.txns if t["fingerprint"] == r["fingerprint"]), None)
        sms_id = r["source"] == "SMS" and key[1] is not None
        clash = same is not None and sms_id and r["strategy"] == "FIELDS" and same["sms_ids"]
        if r["parse_status"] != "FAILED" and same is not None and not clash:
            self._merge(same, r, key, sms_id)
            return "MERGED"
        t = dict(r, txn_id=r["seq"], sms_ids=[key[1]] if sms_id else [], primary_source=r["source"])
        if same is not None:
            t["fingerprint"] += "+" + (key[1] if key[1] is not None else str(r["seq"]))
        self.txns.append(t)
        if key[1] is not None:
            self.by_id[key] = t
        return "FAILED" if r["parse_status"] == "FAILED" else "CREATED"

    def _merge(self, t, r, key, sms_id):
        def midnight(x):
            return x["txn_ts"].time() == dt.time(0)

        if midnight(t) and not midnight(r):
            t["txn_ts"] = r["txn_ts"]
        for c in R.LEDGER_TEXT:
            t[c] = t[c] if t[c] is not None else r[c]
        if t["payment_method"] == "UNKNOWN":
            t["payment_method"] = r["payment_method"]
        rank = ["PARSED", "PARTIALLY_PARSED", "FAILED"].index
        t["parse_status"] = min(t["parse_status"], r["parse_status"], key=rank)
        if r["source"] == "SMS":
            t["is_promotional"] = r["is_promotional"]
        else:
            t["is_promotional"] = t["is_promotional"] and r["is_promotional"]
        if sms_id:
            t["sms_ids"].append(key[1])
        if key[1] is not None:
            self.by_id[key] = t


def random_rows(rng, n, start=0):
    rows = []
    for seq in range(start, start + n):
        source = rng.choice(["SMS", "SMS", "CSV", "PDF"])
        rows.append(
            parsed_row(
                seq,
                source=source,
                source_identifier=rng.choice([None, f"{source}:{rng.randint(0, 12)}", f"{source}:u{seq}"]),
                amount_minor=rng.choice([100, 100, 200, 0]),
                reference_number=rng.choice([None, "123456789012"]),
                txn_ts=DAY + dt.timedelta(hours=rng.choice([0, 0, 5])),
                description=rng.choice([None, "a", "b"]),
                bank_name=rng.choice([None, "x"]),
                payment_method=rng.choice(["UNKNOWN", "UPI", "CARD"]),
                parse_status=rng.choice(["PARSED", "PARSED", "PARTIALLY_PARSED", "FAILED"]),
                is_promotional=rng.random() < 0.4,
            )
        )
    return rows


COMPARED = ["txn_id", "txn_ts", *R.LEDGER_TEXT, "payment_method", "primary_source", "parse_status",
            "is_promotional", "fingerprint"]


def model_ledger(model):
    return {t["fingerprint"]: tuple(t[c] for c in COMPARED) for t in model.txns}


@pytest.mark.parametrize("seed", range(6))
def test_matches_sequential_model(spark, seed):
    rng = random.Random(seed)
    norm = normalise(frame(spark, random_rows(rng, 60)))
    model = Model()
    for r in norm.orderBy("seq").collect():
        model.add(r.asDict())
    result = R.resolve(norm, span=rng.choice([2, 7, 1 << 20]))
    got = {r["seq"]: r["outcome"] for r in result.outcomes.collect()}
    assert got == model.out
    ledger = {r["fingerprint"]: tuple(r[c] for c in COMPARED) for r in result.ledger.collect()}
    assert ledger == model_ledger(model)
    assert result.sources.count() == sum(
        1 for s, o in model.out.items() if s in {r["seq"] for r in result.sources.collect()}
    )


@pytest.mark.parametrize("seed", range(4))
def test_incremental_equals_full(spark, seed):
    rng = random.Random(100 + seed)
    rows = random_rows(rng, 60)
    model = Model()
    for r in normalise(frame(spark, rows)).orderBy("seq").collect():
        model.add(r.asDict())
    first = R.resolve(normalise(frame(spark, rows[:25])))
    store = R.Store(
        spark.createDataFrame(first.ledger.collect(), first.ledger.schema),
        spark.createDataFrame(first.sources.collect(), first.sources.schema),
    )
    second = R.resolve(normalise(frame(spark, rows[25:])), store, span=4)
    got = {r["seq"]: r["outcome"] for part in (first, second) for r in part.outcomes.collect()}
    assert got == model.out
    changed = second.ledger
    merged = store.ledger.join(changed, "fingerprint", "left_anti").unionByName(changed)
    ledger = {r["fingerprint"]: tuple(r[c] for c in COMPARED) for r in merged.collect()}
    assert ledger == model_ledger(model)


# --- literal cases ------------------------------------------------------------


def fingerprints(spark, *variants):
    df = normalise(frame(spark, [parsed_row(i, **v) for i, v in enumerate(variants)]))
    return [r[0] for r in df.orderBy("seq").select("fingerprint").collect()]


def test_identity_across_sources(spark):
    ref = "123456789012"
    base = {"reference_number": ref, "txn_ts": DAY.replace(hour=15, minute=14)}
    same = [
        {**base, "merchant_name": "SWIGGY", "txn_ts": DAY, "account_identifier": "XXXXXXXX1234"},
        {**base, "merchant_name": f"UPI/SWIGGY/{ref}", "reference_number": f"UPI Ref: {ref}"},
        {**base, "reference_number": "1234 5678 9012"},
        {**base, "merchant_name": "Bundl"},
    ]
    other = [
        {**base, "reference_number": "999999999999"},
        {**base, "type": "CREDIT"},
    ]
    got = fingerprints(spark, base, *same, *other)
    assert len(set(got[:5])) == 1 and got[0] not in got[5:]
    plain = {"reference_number": None}
    got = fingerprints(
        spark, plain, {"reference_number": "Ref 12"}, {**plain, "txn_ts": DAY + dt.timedelta(days=1)},
        {**plain, "merchant_name": "Zomato"}, {**plain, "amount_minor": 1},
    )
    assert got[0] == got[1] and len(set(got)) == 4


def test_merge_fills_gaps(spark):
    ref = "123456789012"
    rows = [
        parsed_row(1, source="SMS", source_identifier="sms:1", reference_number=ref, payment_method="UPI",
                   account_identifier=None, txn_ts=DAY.replace(hour=15), parse_status="PARTIALLY_PARSED"),
        parsed_row(2, reference_number=ref, merchant_name="Other", bank_name="HDFC"),
    ]
    row = R.resolve(normalise(frame(spark, rows))).ledger.first()
    assert (row["txn_id"], row["primary_source"], row["bank_name"]) == (1, "SMS", "HDFC")
    assert (row["account_tail"], row["payment_method"], row["parse_status"]) == ("1234", "UPI", "PARSED")
    assert row["txn_ts"] == DAY.replace(hour=15)


def test_two_messages_are_two_payments(spark):
    rows = [
        parsed_row(1, source="SMS", source_identifier="sms:1"),
        parsed_row(2, source="SMS", source_identifier="sms:2"),
        parsed_row(3),
    ]
    res = R.resolve(normalise(frame(spark, rows)))
    assert {r["seq"]: r["outcome"] for r in res.outcomes.collect()} == {
        1: "CREATED", 2: "CREATED", 3: "MERGED"
    }
    assert res.ledger.count() == 2


def test_reference_fallback(spark):
    norm = normalise(frame(spark, [parsed_row(1, reference_number="123456789012"), parsed_row(2)]))
    old = R.resolve(norm).ledger.withColumn("fingerprint", F.concat(F.lit("v0:"), F.col("txn_id")))
    got = R.with_reference_fallback(norm, old).orderBy("seq").select("fingerprint").collect()
    assert got[0][0] == "v0:1" and got[1][0].startswith("v1:")


def test_import_summary(spark):
    rows = [("a", o) for o in ("CREATED", "MERGED", "FAILED")] + [("b", "FAILED"), ("c", "DUPLICATE_SKIPPED")]
    df = spark.createDataFrame(rows, "file string, outcome string")
    got = {r["file"]: (r["status"], r["error_message"]) for r in R.import_summary(df, "file").collect()}
    assert got == {
        "a": ("PARTIAL", "Imported with 1 row(s) that could not be fully understood."),
        "b": ("FAILED", "No new transactions could be imported."),
        "c": ("SUCCESS", None),
    }
