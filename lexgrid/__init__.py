"""lexgrid: clause retrieval and document processing as Spark plans."""
