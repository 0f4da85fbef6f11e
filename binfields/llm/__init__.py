"""Training-data pipeline operators as Spark jobs. Nothing else in the library imports this subpackage."""
