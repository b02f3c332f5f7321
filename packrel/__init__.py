"""packrel: archive entries as relations, on Spark."""
