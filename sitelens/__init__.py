"""Batch audit of crawled websites for personal-data compliance risk, as Spark DataFrame jobs."""
