"""Structured Streaming front end of the stateless operators."""
