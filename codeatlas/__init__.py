"""codeatlas: repository analytics and data processing as Spark plans."""

__version__ = "0.1.0"
