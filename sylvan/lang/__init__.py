"""The pattern language: text to a checked syntax tree with inferred result types."""
