"""Quire plans."""
