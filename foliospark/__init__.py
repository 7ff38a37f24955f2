"""Document analytics on Spark: document, page and block operators as DataFrame transformations."""
