"""Scalar and text expressions."""
