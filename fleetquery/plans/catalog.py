"""All queries of the library by name, and their SQL."""

from __future__ import annotations

from fleetquery.plans import changes, fleet, logs, streams, volume

QUERIES = {**fleet.QUERIES, **volume.QUERIES, **logs.QUERIES, **changes.QUERIES, **streams.QUERIES}
SQL = {**fleet.SQL, **volume.SQL, **logs.SQL, **changes.SQL, **streams.SQL}
