"""Canonical tables of the sources, their readers and checks."""
