"""Readers and writers of manuscripts, pages and review tables."""
