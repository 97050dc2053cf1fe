"""Whole jobs: import of logs, stored tables, dashboards, checks and exports."""
