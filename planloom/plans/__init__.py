"""From syntax to plans to DataFrames: binder, join planner, lowering and lineage."""
