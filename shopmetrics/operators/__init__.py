"""DataFrame operators: the ledger, the metrics over it, ingestion, transforms and checks."""
