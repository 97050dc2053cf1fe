"""Operators from parsed lines to the cube, and the questions asked of the cube."""
