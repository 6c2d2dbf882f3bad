"""stemmata: find copied and stylistically foreign passages with PySpark DataFrames."""
