"""Some of the expressions as SQL functions of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..constants import EMAIL_CATEGORIES, SYSTEM_MARKS

_AUTHORITY = r"lower(regexp_extract(url, r'^(?:[A-Za-z][A-Za-z0-9+.\-]*):?//([^/?#]*)', 1))"
_PATH = r"regexp_replace(regexp_extract(url, r'^(?:(?:[A-Za-z][A-Za-z0-9+.\-]*):)?(?://[^/?#]*)?([^?#]*)', 1), ';[^/]*$', '')"
_SYSTEM = " OR ".join(f"contains(lower(email), '{m}')" for m in SYSTEM_MARKS)
_CATEGORIES = " ".join(f"WHEN lower(email) RLIKE r'{p}' THEN '{n}'" for n, p in EMAIL_CATEGORIES)

#: name: (parameters, type, body)
FUNCTIONS = {
    "url_domain": ("url STRING", "STRING", _AUTHORITY),
    "url_site": ("url STRING", "STRING", rf"regexp_replace({_AUTHORITY}, r'^www\.(?=.*\.)', '')"),
    "url_depth": ("url STRING", "INT", f"size(filter(array(btrim({_PATH}, '/')), x -> x <> '')) * size(split(btrim({_PATH}, '/'), '/'))"),
    "is_system_email": ("email STRING", "BOOLEAN", f"coalesce(email = '', true) OR {_SYSTEM}"),
    "email_category": ("email STRING", "STRING", f"CASE WHEN coalesce(email, '') = '' THEN 'unknown' WHEN {_SYSTEM} THEN 'system' {_CATEGORIES} ELSE 'unknown' END"),
}


def register(spark: SparkSession) -> list[str]:
    """Create the functions as temporary ones; returns their names."""
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    return list(FUNCTIONS)
