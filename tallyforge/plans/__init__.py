"""Whole analyses and question answering, composed from the operators."""
