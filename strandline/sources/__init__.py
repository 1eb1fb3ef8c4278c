"""Readers, writers and shared-storage helpers."""
