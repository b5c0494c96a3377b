"""Scalar building blocks shared by the operators."""
