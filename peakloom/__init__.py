"""peakloom: Spark-native analytics for data-independent-acquisition spectra."""
