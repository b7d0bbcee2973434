"""tessera: evidence tables on Spark (DataFrame-first operators, sources, plans and queries)."""

__version__ = "0.1.0"
