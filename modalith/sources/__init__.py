"""Derived relations, scans and sinks."""
