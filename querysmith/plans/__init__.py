"""Whole plans: policies, interaction rounds, and the catalogue of queries."""
