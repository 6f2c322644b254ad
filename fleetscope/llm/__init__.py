"""Training-data preparation operators (text, vectors, urls, web archives) on Spark.

Nothing else in the library imports this subpackage; ``__spark_entry__.py``
adds its queries only when the subpackage is present.
"""
