"""evalweave: corpus curation, decontamination and evaluation analytics as Spark DataFrame operators."""
