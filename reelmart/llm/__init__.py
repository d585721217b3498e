"""Operators for preparing training data: archives, duplicates, languages, secrets, mixing."""
