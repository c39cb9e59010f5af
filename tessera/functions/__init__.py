"""Scalar functions: byte alphabet, character classes, pretokens."""
