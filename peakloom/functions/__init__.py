"""Functions of peakloom."""
