"""Analytics over transcripts, memory logs, code graphs and claims, as Spark DataFrame operators."""
