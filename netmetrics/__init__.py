"""netmetrics: how important each vertex of a network is, computed with DataFrames."""
