"""Analytics over the history of model libraries, as DataFrame operations."""
