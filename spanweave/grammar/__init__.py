"""Grammars: patterns, their notation, static analysis and compiled programs."""
