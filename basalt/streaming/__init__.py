"""Containers as they arrive: a file stream in bounded batches, with the batch operators behind it."""
