"""Ingest, catalogue, sinks and checkpoints."""
