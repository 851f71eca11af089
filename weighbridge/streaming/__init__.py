"""Scoring and keyed state over streams."""
