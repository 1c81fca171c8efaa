"""Readers, writers and the table stores that survive between runs."""
