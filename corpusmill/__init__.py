"""Corpus analytics on Spark: hashing, exact dedup, reversible transforms, a cost-based planner,
solid packing and a relational catalog, all as lazily composed DataFrame operators."""

__version__ = "0.1.0"
