"""Readers and writers of record lines."""
