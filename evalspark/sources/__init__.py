"""Readers: driver tables, derived views, requests, reports, events, response objects."""
