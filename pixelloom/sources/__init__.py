"""Readers and writers of images, tensors, cache records and record lines."""
