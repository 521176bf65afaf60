"""Scalar time functions."""
