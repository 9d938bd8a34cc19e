"""Readers and writers: catalog tables, folder listings, file decoding."""
