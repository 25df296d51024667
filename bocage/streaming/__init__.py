"""Structured Streaming counterparts of the keyed and windowed operators."""
