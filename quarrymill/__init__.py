"""quarrymill: PySpark operators for event, text, vector and tracking-derived tables."""
