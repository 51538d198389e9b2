"""Runnable jobs: ``python -m jobs.station_hours`` and ``python -m jobs.intake_audit``."""
