"""Intermediate tables, shared with the operators."""

from vocspark.sources.scratch import LOCAL_DEFAULT, Scratch, shared_dir

__all__ = ["LOCAL_DEFAULT", "Scratch", "shared_dir"]
