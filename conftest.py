"""Puts the repository on the path of tests."""
