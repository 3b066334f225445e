"""Readers and writers: text, delimited, compressed and XML files, and model tables."""
