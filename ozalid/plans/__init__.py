"""Registered queries, their SQL and the prediction pipeline."""
