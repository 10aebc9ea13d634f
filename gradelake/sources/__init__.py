"""Readers and writers; parsing is separate from reading so that it also works on streams."""
