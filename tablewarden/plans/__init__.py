"""Suites, and the catalogue of ready-made queries over the test tables."""
