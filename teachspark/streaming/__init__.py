"""Structured Streaming: the stateless preparation operators on a stream."""
