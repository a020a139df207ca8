"""rectide: offline recommendation analytics expressed as Spark DataFrame jobs.

Sub-packages
------------
sources    table readers/writers (Parquet, CSV, JSON lines, manifests) and the
           mapping of the bundled test tables onto the recommendation model
functions  column expressions (behaviour labels, text helpers, id keys)
operators  DataFrame -> DataFrame operators (sequences, features, retrieval,
           reranking, metrics, validation)
plans      end-to-end evaluation / preparation / batch-recommend jobs and the
           registry of named queries
streaming  Structured Streaming variants of the incremental operators
"""

__all__ = ["session"]
