"""Streaming of peakloom."""
