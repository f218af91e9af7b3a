"""Resumable and streaming jobs."""
