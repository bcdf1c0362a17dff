"""Types of the dialect and its scalar and aggregate functions, as Spark SQL."""
