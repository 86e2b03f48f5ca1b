"""Literature analytics on PySpark: tables of papers in, bibliometric tables out."""
