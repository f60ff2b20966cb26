"""Operators of a pipeline for training data, each in a module of its own."""
