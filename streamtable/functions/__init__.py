"""SQL functions that Spark lacks."""
