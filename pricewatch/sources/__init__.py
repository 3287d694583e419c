"""Readers: price tables, raw sheets and the panels derived from the star schema."""
