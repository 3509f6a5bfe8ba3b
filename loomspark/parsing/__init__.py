"""Parsing of markup inside Arrow batches."""
