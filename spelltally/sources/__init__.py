"""Scans, sinks and the scratch folder."""
