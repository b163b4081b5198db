"""Word-sense mining and disambiguation as Spark plans."""

__version__ = "0.1.0"
