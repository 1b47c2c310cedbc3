"""Scans, payload flatteners and sinks."""
