"""Knowledge-base retrieval and text-data operators expressed as Spark DataFrame jobs."""
