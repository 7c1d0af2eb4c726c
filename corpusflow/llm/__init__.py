"""Operators for preparing training data, and their registered queries."""
