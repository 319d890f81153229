"""tidewire: monitored-news analytics expressed as Spark DataFrame jobs."""
