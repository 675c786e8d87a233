"""Compositions of operators: analyze, lock, scoped verify, score overlay."""
