"""Segment storage: manifests, index writer and reader."""
