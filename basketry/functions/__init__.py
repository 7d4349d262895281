"""Column-level helpers: fixed value lists, ordered rule classification,
date arithmetic and null handling. Everything returns ``Column`` expressions so
that work stays inside whole-stage code generation."""
