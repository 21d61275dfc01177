"""lingmill: language identification and n-gram analytics as Spark DataFrame plans."""

__version__ = "0.1.0"
