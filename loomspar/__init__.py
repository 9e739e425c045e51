"""loomspar: catalog, routing, evaluation and corpus analytics on Spark DataFrames."""
