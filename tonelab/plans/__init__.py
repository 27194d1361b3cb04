"""Whole experiments composed from the operators."""
