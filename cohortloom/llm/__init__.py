"""Text operators for training-data pipelines.

Nothing outside this folder, its tests and the pipeline at the repository top imports it.
"""
