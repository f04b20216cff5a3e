"""Tallyline: binary message topics as Spark DataFrames."""

from __future__ import annotations
