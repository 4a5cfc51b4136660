"""Expressions: text, answers, prompts, hashes, arrays and paths."""
