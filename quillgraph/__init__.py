"""quillgraph: graph-Laplacian analytics on Spark DataFrames."""
