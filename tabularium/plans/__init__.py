"""Predicates and the index descent that turns them into the blocks to read."""
