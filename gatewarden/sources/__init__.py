"""Readers that turn landed vendor exports and logs into canonical tables, and table sinks."""
