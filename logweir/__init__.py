"""Log-event processing on Spark: decode, enrich, redact, merge, queue and ledger transforms."""
