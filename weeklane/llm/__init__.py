"""Operators of a training-data pipeline: near copies, contamination, mixing, secrets, search,
URL rules, token counts, repeated passages, toxicity and language-model scores.

Nothing outside this folder imports it.
"""
