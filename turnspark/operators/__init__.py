"""Relational operators on turn, score and trial tables."""
