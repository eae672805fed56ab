"""Analytics over financial disclosures, and training-data operators, as Spark jobs."""
