"""Readers, writers and shared scratch tables."""
