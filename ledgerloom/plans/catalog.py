"""All registered queries."""

from ledgerloom.plans import (  # noqa: F401
    identity_queries,
    ledger_queries,
    report_queries,
    stream_queries,
    text_queries,
)
from ledgerloom.plans.registry import ORACLE, QUERIES  # noqa: F401
