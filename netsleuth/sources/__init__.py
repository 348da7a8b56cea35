"""Readers: driver tables -> flow records, JSON-lines events, rule files, artefacts."""
