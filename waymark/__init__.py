"""waymark: bulk analytics over hierarchical address registries, on PySpark."""
