"""Analytics over semi-structured collections, written as Spark plans."""
