"""Operators for preparing training corpora; tables are ``documents(doc_id, text, lang, source, n_chars)``."""
