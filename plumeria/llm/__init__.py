"""Operators for preparing large text corpora; nothing else in the library imports this subpackage."""
