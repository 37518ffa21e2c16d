"""Imports every module that registers queries."""

from ledgerloom.plans import (  # noqa: F401
    commands,
    details,
    documents,
    evalkit,
    language,
    ledger,
    relational,
    retrieval,
    rules,
    sales,
    supply,
)
from ledgerloom.streaming import ledgers, threads  # noqa: F401
