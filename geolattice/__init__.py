"""Geospatial data operators over tables and streams, written for Spark."""
