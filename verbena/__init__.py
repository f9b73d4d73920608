"""Verbena: traceable semantic relations and corpus operators on PySpark."""

__version__ = "0.1.0"
