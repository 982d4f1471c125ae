"""Schemas: text or builder in, sealed model out."""
