"""Readers, membership, calendars and sinks of panels."""
