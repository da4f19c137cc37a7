"""Outputs: redacted PDF files and Markdown."""
