"""Readers, writers, typing of raw columns and the canonical test frames."""
