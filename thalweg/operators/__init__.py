"""Relational building blocks: network, runoff, weights and validation."""
