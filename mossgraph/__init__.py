"""Analytics over document collections and their graphs, as DataFrame and SQL plans."""
