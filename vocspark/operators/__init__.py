"""Transforms over messages, conversations, topics, runs and search results."""
