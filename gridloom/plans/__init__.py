"""Selections, planned on the driver before any data is read."""
