"""Stages built from the operators, and the whole preparation run."""
