"""Readers and writers: catalogue JSON, manifests, markup texts, pixel tables."""
