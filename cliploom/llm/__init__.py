"""Operators that prepare text, vectors and conversations for training language models.

Each operator has a module; ``queries`` registers them. Nothing else in the package imports this.
"""
