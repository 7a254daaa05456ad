"""Survey statistics and text operators as lazy Spark plans."""
