"""Operators of a training-data pipeline: de-duplication, filtering, extraction, mixing and sharding of documents."""
