"""Structured Streaming forms of ingestion, trends and conversation state."""
