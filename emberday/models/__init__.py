"""Spark ML fits, calibration and scoring."""
