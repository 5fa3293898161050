"""Typed pattern queries over ordered, labelled trees, on Spark."""
