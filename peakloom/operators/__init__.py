"""Operators of peakloom."""
