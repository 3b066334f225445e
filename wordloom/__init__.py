"""Lexical analytics of historical text on Spark."""
