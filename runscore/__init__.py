"""Judging recorded data-analysis runs, and the data jobs they are about, on Spark."""
