"""Operators over pairs, poses, atoms, splits and evaluations."""
