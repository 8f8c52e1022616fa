"""meshloom: partitioning and analysis of large unstructured meshes on Spark DataFrames."""
