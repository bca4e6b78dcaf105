"""Plans of peakloom."""
