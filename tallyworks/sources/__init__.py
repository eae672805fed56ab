"""Readers of landed payloads and writers of typed tables. Fetching stays outside: files land first."""
