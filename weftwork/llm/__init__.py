"""Training-data pipeline operators on PySpark.

One module per operator; ``queries`` holds the registered queries and their SQL.
Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
