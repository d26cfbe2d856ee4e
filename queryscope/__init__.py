"""queryscope: search-query, ranking, page and text analytics on PySpark."""

__version__ = "0.1.0"
