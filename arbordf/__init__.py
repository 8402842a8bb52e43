"""arbordf: path queries and rule-based tree transformation expressed as Spark plans."""

__version__ = "0.1.0"
