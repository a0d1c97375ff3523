"""Bindings, scans and sinks."""
