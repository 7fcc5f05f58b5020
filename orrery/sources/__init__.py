"""Readers and writers of trajectory, structure, log and series text."""
