"""Whole runs: layout, rendering, reports, sinks and the query catalogue."""
