"""Training-data operators: quality, deduplication, language, chat, markup, licences, tokens."""
