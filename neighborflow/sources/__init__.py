"""Readers and writers of row tables."""
