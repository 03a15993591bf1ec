"""Readers, lookups, sinks and the shared folder for intermediate tables."""
