"""Streaming form of the mapping stage."""
