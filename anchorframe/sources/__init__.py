"""Readers, writers and generated spines."""
