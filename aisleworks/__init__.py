"""Omnichannel retail analytics as Spark DataFrame, Structured Streaming and Spark ML jobs."""
