"""Readers and writers of annotation XML, GeoJSON, mappings, box labels and measurement tables."""
