"""Document-intelligence operators for PySpark: declarative first, Arrow batches where a text must be walked."""

__version__ = "0.1.0"
