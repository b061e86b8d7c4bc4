"""Structured Streaming over the mutation log."""
