"""Readers and writers: archive files, text splits, file listings."""
