"""gleanspark: build and judge retrieval-augmented question answering data on Spark.

Every operator takes DataFrames and gives DataFrames back. Rows are matched by
explicit keys, never by position, and results do not depend on partitioning.
"""

__all__ = ["functions", "operators", "plans", "schemas", "sources"]
