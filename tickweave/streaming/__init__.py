"""The same table semantics on Structured Streaming."""
