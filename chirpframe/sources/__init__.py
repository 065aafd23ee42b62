"""Scans and sinks. Every scan states its schema."""
