"""Operators for preparing and scoring text corpora; nothing else in the library imports this subpackage."""
