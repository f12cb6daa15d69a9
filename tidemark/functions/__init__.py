"""Scalar codecs as column expressions."""
