"""Standardisation of battery-cycler measurements on Spark."""
