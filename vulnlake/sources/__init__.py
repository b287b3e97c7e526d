"""Readers (S01-S10) and writers."""
