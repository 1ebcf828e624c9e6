"""Market-data operators for PySpark: causal joins, event studies, book arithmetic, audits."""
