"""Readers, file gates and sinks."""
