"""Quire operators."""
