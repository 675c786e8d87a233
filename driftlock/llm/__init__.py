"""Operators for preparing training data at cluster scale, and their registered queries."""
