"""Ratings that keep arriving."""
