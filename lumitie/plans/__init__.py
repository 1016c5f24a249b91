"""Calibration phases and reports built from the operators."""
