"""Operators for training data: sharding, search, deduplication, filters, tokens."""

from __future__ import annotations
