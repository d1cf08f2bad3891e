"""Operators for large text corpora: language ID, top-k search, chat formatting, dedup, LM scoring, tokenising, packing."""
