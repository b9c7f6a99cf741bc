"""Readers, typed scans, appends, sinks and test views."""
