"""Tessera: byte-level BPE analytics as Spark plans, and operators for training-data pipelines."""
