"""kinsift: duplicate and near-duplicate analytics expressed as Spark DataFrames."""
