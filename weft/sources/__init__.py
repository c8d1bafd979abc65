"""Readers, writers and the views over the test tables."""
