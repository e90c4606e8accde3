"""Reading and writing catalogs, vectors, indexes and job metadata."""
