"""Term index, identifier resolution and ontology curation as Spark DataFrames."""

from termweave.model import Index, active_priority, literal_table

__all__ = ["Index", "active_priority", "literal_table"]
