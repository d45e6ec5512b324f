"""Every named query with the SQL that DuckDB answers it by."""

from __future__ import annotations

from plait.plans import further, more, numbers, texts
from plait.streaming import regions

QUERIES = {**numbers.QUERIES, **texts.QUERIES, **more.QUERIES, **further.QUERIES, "q_stream_regions": regions.run}
ORACLE = {**numbers.ORACLE, **texts.ORACLE, **more.ORACLE, **further.ORACLE}
ORACLE["q_stream_regions"] = f"WITH e AS (SELECT event_id, CAST(event_id AS BIGINT) AS k, CASE WHEN event_id = 0 THEN 1 ELSE 4 * ((length(bin(event_id)) + 3) // 4) END AS len FROM events) SELECT event_id, replace(lpad(bin(k), CAST(len AS INTEGER), '0'), '1', '+') AS cells, {numbers.frac('k', numbers.two('len'))} AS value FROM e"
