"""Sinks: report formats and safe writes."""
