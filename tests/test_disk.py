"""What resolving and the store leave on disk while they work: narrow flags, passes, scratch tables, tables kept in place."""

import datetime as dt
import os
import random

from pyspark.sql import functions as F

from ledgerloom.operators import resolve
from ledgerloom.operators.normalise import normalise
from ledgerloom.schemas import PARSED_SCHEMA
from ledgerloom.session import Scratch, stage_table, staged_in_passes
from ledgerloom.sources.store import LedgerStore


def _rows(spark, n=40):
    rng, at = random.Random(5), dt.datetime(2026, 1, 2, 3, 4)
    rows = [
        (
            i, rng.choice([100, 200, 0]), "INR", "DEBIT", at, rng.choice([None, "d"]), "Shop", rng.choice([None, "412345678901"]), None, None,
            "UPI", "SMS", rng.choice([None, f"sms:{rng.randint(0, 6)}", f"sms:u{i}"]), "AX", rng.choice(["PARSED", "FAILED"]), None, rng.random() < 0.5,
        )
        for i in range(n)
    ]
    return stage_table(normalise(spark.createDataFrame(rows, PARSED_SCHEMA)), "rows")


def _all(df):
    return sorted(map(str, df.collect()))


def test_passes_give_what_one_pass_gives(spark):
    rows = _rows(spark)
    whole, dealt = resolve.resolve(rows), resolve.resolve(rows, pass_rows=9)
    assert (whole.passes, dealt.passes > 1) == (1, True)
    for part in ("outcomes", "ledger", "sources"):
        assert _all(getattr(whole, part)) == _all(getattr(dealt, part))
    in_passes = staged_in_passes(whole.ledger, "ledger", "fingerprint", 3)
    assert _all(in_passes) == _all(whole.ledger) and len(in_passes.inputFiles()) >= 3


def test_rows_are_shuffled_only_for_written_narrow_flags(spark):
    written = {}

    def stage(df, purpose):
        written[purpose] = stage_table(df, purpose)
        return written[purpose]

    tagged = resolve.tag_rows(_rows(spark), stage=stage)
    assert set(written["flags"].columns) == {"seq", "_again", "opens", "_mark"}
    assert tagged._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
    assert tagged.count() == 40


def test_scratch_tables_go_when_they_are_not_read_any_more(spark):
    with Scratch(spark) as scratch:
        scratch.stage(spark.range(3), "one")
        two = scratch.stage(spark.range(4), "two")
        (_, one), (_, other) = scratch.paths
        scratch.discard("one")
        assert not os.path.exists(one) and two.count() == 4
    assert not os.path.exists(other)


def test_compaction_leaves_other_tables_where_they_lie(spark, tmp_path):
    store = LedgerStore(spark, str(tmp_path / "s"))
    result = resolve.resolve(_rows(spark), pass_rows=9)
    history = resolve.import_summary(result.outcomes.withColumnRenamed("origin_label", "file_name"), "file_name", "source")
    assert result.passes > 1 and store.append(result, history, "run", 0)
    tables = {t: _all(getattr(store, t)().drop("batch_id")) for t in ("ledger", "sources", "outcomes", "history")}
    assert tables["ledger"] == _all(result.ledger) and tables["sources"] == _all(result.sources)
    files = set(store.sources().inputFiles())
    # What a batch left without a commit does not come back with the next generation.
    store._write("sources", store.sources().withColumn("seq", F.col("seq") + 1000), 0, 1)
    store.compact()
    assert store.head().generation == 1 and set(store.sources().inputFiles()) == files
    assert {t: _all(getattr(store, t)().drop("batch_id")) for t in tables} == tables
    assert not os.path.exists(f"{store.root}/sources/generation=1")
    store.reset()
    assert store.sources().count() == 0
