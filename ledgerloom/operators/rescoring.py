"""The classifier run again over what a store holds."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ledgerloom.operators import model, search
from ledgerloom.session import stage_table
from ledgerloom.sources.store import LedgerStore


def rescore_store(store: LedgerStore, run: str, coefficients: model.Coefficients = model.BUILT_IN) -> DataFrame:
    """Hide stored rows whose text is not a payment; counts of rows judged and hidden.

    Only rows that change are written, as new versions in a batch of their own. A run that was committed is not
    written twice; its counts are then those of the rows still shown.
    """
    sources = store.sources()
    candidates = search.rescore_candidates(store.ledger(), sources, key="fingerprint")
    judged = model.rescore(candidates, sources, coefficients, key="fingerprint", order=("seq",))
    verdicts = stage_table(judged.select("fingerprint", "hide"), "rescored")
    hidden = verdicts.filter("hide")
    if not hidden.isEmpty():
        shown = store.ledger().join(hidden.select("fingerprint"), "fingerprint", "left_semi")
        store.amend(model.hide_rescored(shown, hidden, key="fingerprint"), run)
    return model.rescore_summary(verdicts)
