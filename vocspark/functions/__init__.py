"""Column functions over text and labels."""
