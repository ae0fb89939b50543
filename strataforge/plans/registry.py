"""Named queries over the driver's tables, and DuckDB SQL for each that SQL can express."""

from __future__ import annotations

from . import assets, audits, coordination, curation, datasets, files, flows, ledgers, measures, playback, replies, reports, scenes, structure

QUERIES = reports.QUERIES | curation.QUERIES | flows.QUERIES | audits.QUERIES | assets.QUERIES | scenes.QUERIES | datasets.QUERIES | files.QUERIES | coordination.QUERIES | structure.QUERIES | measures.QUERIES | replies.QUERIES | ledgers.QUERIES | playback.QUERIES
ORACLE_SQL = reports.SQL | curation.SQL | flows.SQL | audits.SQL | assets.SQL | scenes.SQL | datasets.SQL | files.SQL | coordination.SQL | structure.SQL | measures.SQL | replies.SQL | ledgers.SQL | playback.SQL
