"""Keyed stateful operators for live frames, scores and the adaptive controller."""
