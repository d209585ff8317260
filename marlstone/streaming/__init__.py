"""Structured Streaming operators; each runs on a batch frame too where its state allows."""
