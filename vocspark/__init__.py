"""Spark jobs that turn large volumes of support messages into service analytics."""
