"""Operators on cue tables."""
