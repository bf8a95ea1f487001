"""Relational operators over the decoded event log."""
