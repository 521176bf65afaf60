"""Readers: line protocol and InfluxQL."""
