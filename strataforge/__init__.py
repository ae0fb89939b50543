"""strataforge: curation and analysis of instruction corpora and event data on Spark."""
