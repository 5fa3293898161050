"""Operators that run a checked pattern over one document's nodes."""
