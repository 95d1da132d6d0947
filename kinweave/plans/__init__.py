"""Whole jobs: output projection, reports and the end-to-end pipeline."""
