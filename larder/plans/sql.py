"""Pieces of DuckDB SQL that read the untidy values as larder.functions.values does."""

from __future__ import annotations

_SHA = "regexp_replace(regexp_replace(lower({c}), '^\\s*(sha-?256\\s*[:=\\-]?|0x)', ''), '[\\s:\\-_]', '', 'g')"
_PH = "regexp_replace(regexp_replace(lower({c}), '\\s', '', 'g'), '^(0x|#)', '')"
_NAME = "nullif(trim(regexp_replace(lower({c}), '[^a-z0-9]+', '_', 'g'), '_'), '')"
_RAW_GROUP = "CASE WHEN source_group IS NULL OR NOT regexp_matches(source_group, '\\S') THEN image_path ELSE source_group END"


def sha(c: str) -> str:
    x = _SHA.format(c=c)
    return f"CASE WHEN regexp_full_match({x}, '[0-9a-f]{{64}}') THEN {x} END"


def ph(c: str) -> str:
    x = f"nullif(regexp_extract({_PH.format(c=c)}, '^0*([0-9a-f]{{1,16}})$', 1), '')"
    return f"nullif(nullif(CAST('0x' || {x} AS UBIGINT), 0), 18446744073709551615)"


def name(c: str) -> str:
    return _NAME.format(c=c)


def split(c: str) -> str:
    x = f"regexp_replace(lower({c}), '[^a-z]', '', 'g')"
    return (f"CASE WHEN {x} IN ('train', 'training') THEN 'train' WHEN {x} IN ('val', 'valid', 'validation') THEN 'valid' "
            f"WHEN {x} IN ('test', 'testing') THEN 'test' END")


CAPTURE = name(f"regexp_replace(regexp_extract(regexp_replace({_RAW_GROUP}, '[/\\\\\\s]+$', ''), '([^/\\\\]*)$', 1), '(?is)\\.rf\\..*$', '')")
FOLDER = "regexp_extract(lower(rel_path), '(?:^|[/\\\\])\\s*(train|training|val|valid|validation|test|testing)\\s*[/\\\\]', 1)"
AUDIT_SPLIT = f"CASE WHEN split IS NULL OR NOT regexp_matches(split, '\\S') THEN {split(FOLDER)} ELSE {split('split')} END"
_RAW_URL = "regexp_replace(trim(image_url, ' \t\n\r'), '#.*$', '')"
URL_PARTS = f"""
u0 AS (SELECT *, regexp_replace({_RAW_URL}, '^([A-Za-z][A-Za-z0-9+.\\-]*:)?//', '') AS rest FROM recipe_candidate),
u1 AS (SELECT *, lower(regexp_extract(rest, '^(?:[^/?@]*@)?([^/?:]*)', 1)) AS host, url_decode(regexp_extract(rest, '^[^/?]*([^?]*)', 1)) AS path,
        url_decode(regexp_extract(regexp_extract(rest, '\\?(.*)$', 1), '(?:^|&)(?:i|%69)(?:d|%64)=([^&]*)', 1)) AS ident FROM u0)"""
URL = "CASE WHEN host <> '' AND NOT starts_with(path, '/static/') THEN host || chr(10) || CASE path WHEN '' THEN '/' ELSE path END || chr(10) || ident END"
