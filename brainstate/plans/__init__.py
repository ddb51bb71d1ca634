"""Workflows and registered queries."""
