"""A PySpark-native engine for studying how repeated, noisy answers to a controlled benchmark agree with their sources."""
