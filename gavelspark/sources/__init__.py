"""Readers, writers, codecs and event generation."""
