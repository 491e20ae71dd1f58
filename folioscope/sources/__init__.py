"""Readers and writers of the files that feeds, registries and editors exchange."""
