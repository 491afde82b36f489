"""Long-read overlap analytics and record processing on Spark."""
