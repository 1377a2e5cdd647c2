"""Bibliometric analytics as Spark DataFrame functions."""
