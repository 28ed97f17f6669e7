"""Change feeds and live queries on Structured Streaming."""
