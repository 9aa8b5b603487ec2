"""A PySpark engine for numbered bilingual documents: ingest, hybrid retrieval, evaluation and data checks."""
