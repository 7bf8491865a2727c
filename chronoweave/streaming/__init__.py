"""Analyses that follow a growing table."""
