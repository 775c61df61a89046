"""Forecasters in numpy, run as grouped pandas functions."""
