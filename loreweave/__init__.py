"""Evidence-linked knowledge tables from long texts, as Spark DataFrame jobs."""
