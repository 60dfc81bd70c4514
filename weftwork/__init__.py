"""weftwork: a Spark-first analytics engine for catalogues of linked entities."""
