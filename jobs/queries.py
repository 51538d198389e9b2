"""The jobs as queries, with their SQL."""

from . import intake_audit, station_hours

QUERIES = {"job1_station_hours": station_hours.query, "job2_intake_audit": intake_audit.query}
ORACLES = {"job1_station_hours": station_hours.SQL, "job2_intake_audit": intake_audit.sql()}
