"""DuckDB equivalents of the queries that SQL can express."""

ORACLE: dict[str, str] = {}

ORACLE["op9_mixing"] = r"""
WITH sized AS (
    SELECT doc_id, source,
           coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
           md5('42|' || coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))) AS key
    FROM documents
), sources AS (
    SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS turn
    FROM sized GROUP BY source
), limits AS (
    SELECT source, source_size, 2.0::DOUBLE * source_size AS most,
           CASE turn % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::DOUBLE AS weight
    FROM sources
), levels AS (
    SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
    FROM limits
), targets AS (
    SELECT source, source_size,
           round(coalesce(least(most, weight * max(CASE WHEN level * weight < most THEN level END) OVER ()), most), 6) AS target
    FROM levels
), runs AS (
    SELECT s.doc_id, s.size, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
           coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
    FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0
            ELSE size * (budget // source_size) + greatest(0, least(size, budget % source_size - before)) END::BIGINT AS taken
FROM runs
"""
