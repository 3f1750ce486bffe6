"""Kept empty: path queries are defined over finished graphs, and no query here has an unbounded input."""
