"""Stateful routing over structured streams."""
