"""Readers and writers for corpora, reports, pattern lists, usage logs and baselines."""
