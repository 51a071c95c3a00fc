"""Operators over the click table: windows, profile, quality, sampling, metrics, triage."""
