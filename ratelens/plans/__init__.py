"""Composite jobs: several operators behind one function."""
