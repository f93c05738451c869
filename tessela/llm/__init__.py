"""Corpus-preparation operators; nothing else in the package imports them."""
