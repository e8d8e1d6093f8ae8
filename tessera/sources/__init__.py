"""Readers, writers, parameters and generated recordings."""
