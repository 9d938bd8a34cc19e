"""Search, catalog upkeep and cited retrieval for technical documents on Spark."""
