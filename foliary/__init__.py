"""Document-library analytics as DataFrame -> DataFrame operators on PySpark."""

__version__ = "0.1.0"
