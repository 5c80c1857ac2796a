"""motionloom: a PySpark-native engine for keypoint, segment, annotation and cohort analytics."""
