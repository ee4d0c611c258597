"""Event-stream operators for PySpark, for batch and streaming DataFrames alike."""
