"""Operators for training data: similarity clusters, repeated events, packing, leaked passages and shared spans."""
