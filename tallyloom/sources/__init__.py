"""Readers, sinks and staging."""
