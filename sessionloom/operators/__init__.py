"""Operators: plain ``DataFrame -> DataFrame`` functions."""
