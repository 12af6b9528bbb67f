"""Event-stream segmentation, interval algebra and span scoring on Spark DataFrames."""
