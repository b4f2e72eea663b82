"""Readers, writers and the tick-to-bar builder."""
