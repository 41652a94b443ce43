"""Readers, writers and catalog tables."""
