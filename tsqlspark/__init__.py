"""PySpark-native analytics engine for a compact T-SQL dialect."""
