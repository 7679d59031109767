"""Analytics over deduplicated, versioned backup stores, expressed as Spark DataFrames."""
