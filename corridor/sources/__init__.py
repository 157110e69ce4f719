"""Readers, writers and the stage store."""
