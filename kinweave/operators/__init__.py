"""Distributed operators: linking, clustering, fusing, enriching."""
