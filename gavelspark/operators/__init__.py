"""Batch and streaming operators: every one is a function from frames to a frame."""
