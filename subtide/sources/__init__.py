"""Readers and writers: recordings, JSON columns, glossaries, reports."""
