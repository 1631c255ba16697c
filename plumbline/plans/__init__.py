"""Composite plans: scoring, team style, player style and matching."""
