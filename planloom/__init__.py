"""planloom: a small, exactly specified SELECT dialect lowered to PySpark DataFrames, with lineage and join planning."""
