"""Readers and writers of alignment, tree and partition formats."""
