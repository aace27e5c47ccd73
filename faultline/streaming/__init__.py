"""Monitoring as Structured Streaming, over the same operators as batch."""
