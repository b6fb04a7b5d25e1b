"""skein: a PySpark-native analytics library for docked-pose tables and text corpora."""
