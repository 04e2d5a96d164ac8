"""inkwell: a Spark-first engine for narrative text and document pipelines."""
