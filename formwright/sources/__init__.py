"""Readers, user hooks and sinks."""
