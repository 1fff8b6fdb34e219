"""Landed pages as a stream into stored tables."""
