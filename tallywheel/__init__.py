"""Token accounting on Spark: from raw blocks, logs and traces to a balanced ledger and its marts."""
