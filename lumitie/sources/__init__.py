"""Readers, sinks, staging tables."""
