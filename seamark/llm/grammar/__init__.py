"""Recursive-descent statement parsers with precedence-climbing expressions and panic-mode recovery, one module per language."""
