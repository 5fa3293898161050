"""Text functions of the pattern language."""
