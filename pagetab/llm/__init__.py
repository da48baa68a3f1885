"""Operators on documents, vectors and pages that prepare training data."""
