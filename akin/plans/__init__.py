"""Decisions taken when a plan is built: thresholds, bounds and candidates."""
