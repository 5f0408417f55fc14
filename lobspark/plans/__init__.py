"""Whole queries: views on tables, replay, gates and their SQL."""
