"""Operators on corpora and set-valued records for training data; nothing outside imports them."""
