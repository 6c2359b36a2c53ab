"""Operators of a training-data pipeline: deduplication, quality, packing, mixing, personal data, chats, languages."""
