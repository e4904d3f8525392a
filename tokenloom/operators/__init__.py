"""Operators on tables: encoding, decoding, lookups and relations of tokens."""
