"""Operators for preparing large text collections: tokenizing, filtering, linking, searching, packing."""
