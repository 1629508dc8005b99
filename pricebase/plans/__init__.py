"""Shared views, filters and the typed query API."""
