"""quillgrid: document-collection analytics as PySpark DataFrame pipelines."""
