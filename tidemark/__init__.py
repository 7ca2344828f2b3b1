"""Point-in-time analytics on Spark: bars, targets, features, ledgers and quote replay."""
