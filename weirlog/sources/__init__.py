"""Readers and writers of the files that log mining works with."""
