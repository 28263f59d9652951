"""Listing recommendation and corpus preparation jobs for Spark."""
