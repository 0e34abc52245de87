"""Operators for preparing training data: dedup, packing, mixing, filters, archives, chats."""
