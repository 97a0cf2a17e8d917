"""Reusable DataFrame operators that more than one analysis builds on."""
