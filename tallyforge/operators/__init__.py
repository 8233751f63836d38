"""Analytic operators: each is a function from DataFrame to DataFrame."""
