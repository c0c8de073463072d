"""tractloom: a Spark-native engine for trajectory, voxel and connectivity analytics."""

__version__ = "0.1.0"
