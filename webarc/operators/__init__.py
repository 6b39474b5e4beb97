"""Jobs over DataFrames of records and texts."""
