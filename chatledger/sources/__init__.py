"""Readers and writers of the event log and of the tables derived from it."""
