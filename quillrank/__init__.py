"""Neural-search data work as Spark DataFrame jobs."""
