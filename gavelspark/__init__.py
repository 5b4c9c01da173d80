"""Auction-stream analytics as ordinary Spark DataFrame functions."""
