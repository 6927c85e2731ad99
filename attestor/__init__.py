"""Document evidence and corpus preparation as Spark DataFrame programs."""
