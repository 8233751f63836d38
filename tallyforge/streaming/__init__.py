"""Structured Streaming forms of the metering, rate-limit and trend operators."""
