"""Readers and writers for corpora, result tables and language names."""
