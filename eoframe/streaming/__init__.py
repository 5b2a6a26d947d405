"""Incremental intake with Structured Streaming."""
