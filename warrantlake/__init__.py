"""Warrantlake: evidence and drift analytics for detectors, as PySpark DataFrame operators."""
