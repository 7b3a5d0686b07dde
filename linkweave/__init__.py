"""linkweave: web addresses of scholarly documents in context, as Spark DataFrame plans."""

__version__ = "0.1.0"
