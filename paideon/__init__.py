"""Learning analytics and document structuring as Spark DataFrame jobs."""
