"""DataFrame operators: observations, scores, metrics, resampling, vectors, planning."""
