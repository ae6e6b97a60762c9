"""Graphs, lattices and grammars as node and arc tables."""
