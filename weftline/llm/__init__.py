"""Operations of a training-data pipeline: search, filters, deduplication, sharding, mixing and tokenisation.

Nothing else in the library imports this subpackage.
"""
