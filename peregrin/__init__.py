"""peregrin: a Spark-native engine for vehicle-trajectory analytics."""
