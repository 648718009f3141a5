"""Live operators on Structured Streaming."""
