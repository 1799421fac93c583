"""tidemark: market-series and journal analytics expressed as Spark plans."""
