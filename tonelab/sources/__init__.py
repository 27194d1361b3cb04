"""Readers, writers and the shared scratch folder."""
