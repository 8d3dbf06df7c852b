"""Scalar functions with the semantics of a managed runtime, all as Column expressions."""
