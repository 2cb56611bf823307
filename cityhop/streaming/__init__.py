"""Serving request streams with the batch plans (Structured Streaming)."""
