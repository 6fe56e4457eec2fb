"""Operators for preparing large training corpora; nothing outside this package imports it."""
