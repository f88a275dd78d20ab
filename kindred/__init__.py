"""Bayesian entity resolution on Spark."""
