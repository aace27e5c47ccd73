"""Readers: files by format, text held in table columns, scenario catalogues."""
