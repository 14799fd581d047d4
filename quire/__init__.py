"""quire: document analytics over DataFrames."""
