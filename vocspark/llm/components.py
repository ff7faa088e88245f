"""Connected components, shared with the operators."""

from vocspark.operators.components import components, extended

__all__ = ["components", "extended"]
