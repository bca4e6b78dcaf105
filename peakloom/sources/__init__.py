"""Sources of peakloom."""
