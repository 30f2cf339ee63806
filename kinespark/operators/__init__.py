"""Relational and dense operators on traces, trials and result tables."""
