"""Compositions: silver, gold and emissions loads, staged SQL steps, audit log."""
