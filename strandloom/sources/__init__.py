"""Readers and writers of alignment, interval, call and sequence tables."""
