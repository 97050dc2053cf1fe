"""The library's scalar rules and its report reader as functions of Spark SQL.

``register`` makes them temporary functions of a session.  They are SQL themselves, so the optimizer sees
through them, and give what the Python functions of the same names give.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from hitloom.functions.agents import WINDOWS_RELEASES
from hitloom.operators.agents import BOUNDARY


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def definitions() -> dict[str, str]:
    """The statement that makes each function."""
    group = lambda n: f"regexp_extract(ua, pattern, {n})"
    fill = lambda text, n: f"CASE WHEN contains({text}, '${n}') THEN replace({text}, '${n}', {group(n)}) ELSE {text} END"
    releases = " ".join(f"WHEN startswith(version, {_literal(number)}) THEN {_literal(name)}" for number, name in WINDOWS_RELEASES)
    count = lambda field: f"coalesce(try_cast(try_variant_get(entry.value, concat('$.', {field}), 'string') AS BIGINT), 0L)"
    return {
        "bounded_pattern": f"(pattern STRING) RETURNS STRING RETURN concat({_literal(BOUNDARY)}, pattern, ')()()')",
        "filled_version": f"(ua STRING, pattern STRING, template STRING) RETURNS STRING RETURN (SELECT btrim({fill('one', 2)}, ' .') FROM (SELECT {fill('coalesce(template, ' + _literal('') + ')', 1)} AS one))",
        "windows_version": f"(version STRING) RETURNS STRING RETURN CASE {releases} ELSE version END",
        "report_rows": f"""(body STRING, dim STRING, pv_field STRING, v_field STRING, key_field STRING)
            RETURNS TABLE (datum DATE, dim STRING, dimkey STRING, pv BIGINT, v BIGINT)
            RETURN SELECT try_cast(day.key AS DATE), report_rows.dim, try_variant_get(entry.value, concat('$.', key_field), 'string'), {count('pv_field')}, {count('v_field')}
            FROM variant_explode(try_parse_json(body)) AS day(pos, key, value), LATERAL variant_explode(day.value) AS entry(pos, key, value)
            WHERE schema_of_variant(day.value) LIKE 'ARRAY%' AND try_cast(day.key AS DATE) IS NOT NULL AND try_variant_get(entry.value, concat('$.', key_field), 'string') IS NOT NULL""",
    }


def register(spark: SparkSession) -> None:
    """Makes ``bounded_pattern``, ``filled_version``, ``windows_version`` and the table function
    ``report_rows`` (of the text of a report file) known to ``spark.sql``."""
    for name, rest in definitions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name} {rest}")
