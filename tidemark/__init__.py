"""Point-in-time analytics on PySpark: ledgers, as-of features, forecasts, text rules."""
