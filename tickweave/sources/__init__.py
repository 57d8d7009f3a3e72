"""Readers, writers and the incremental work plan."""
