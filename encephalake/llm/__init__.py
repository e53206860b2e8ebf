"""Operators for preparing training text: quality, language, duplicates, packing, archives, tokens and chat."""
