"""Coding-agent telemetry analytics on Spark."""
