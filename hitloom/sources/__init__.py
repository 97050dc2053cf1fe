"""Readers of logs, geo ranges, pattern lists, site lists and report files."""
