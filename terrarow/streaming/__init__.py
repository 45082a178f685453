"""Structured Streaming forms of ordered operators; an extension beyond batch use."""
