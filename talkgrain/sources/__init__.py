"""Readers and writers for catalogue, transcript, video-item and response data."""
