"""PySpark-native analytics over biological sequences, motifs, ranges and hits."""
