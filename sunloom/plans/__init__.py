"""Whole plans: the index of valid reference times, samples and batches."""
