"""Micro-batch serving of recommendation requests.

The analytics themselves are batch jobs (the reference reads whole files and
has no watermark, window or state logic). What arrives over time are
requests: lists of customer ids to answer with their purchase history and
recommendations. ``requests.serve`` runs that answer per micro-batch of
request files with Structured Streaming.
"""
