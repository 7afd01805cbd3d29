"""Panel analytics on Spark: tables keyed by an entity code and a date."""
