"""Operators: DataFrame → DataFrame functions without actions unless their docstring says so."""
