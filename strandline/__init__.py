"""strandline: genotyping of structural variants without read alignment, as Spark jobs."""
