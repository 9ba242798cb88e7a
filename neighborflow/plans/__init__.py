"""Stores and loaders: the public entry points."""
