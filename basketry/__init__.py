"""basketry: retail analytics (sales report, customer segmentation, item
recommendation) expressed as Spark DataFrame jobs.

Sub-packages:
  sources    readers, writers and the adapter from the star-schema tables
  functions  column-level helpers (fixed value lists, rule classification, dates)
  operators  DataFrame -> DataFrame building blocks (sales, features, segments,
             interactions, recommendation, evaluation)
  plans      end-to-end jobs composed from operators
  streaming  micro-batch serving of recommendation requests
"""

from basketry.settings import Settings

__all__ = ["Settings"]
