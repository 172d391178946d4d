"""Supply-chain analytics on PySpark: quality-checked sales, gold roll-ups, risk, forecasts, metrics and governance."""
