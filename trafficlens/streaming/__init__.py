"""The operators over Structured Streaming."""
