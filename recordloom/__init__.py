"""recordloom: record generation, linkage and match-quality scoring as Spark plans."""
