"""Pieces of DuckDB SQL for the oracles."""

from __future__ import annotations

TRACKING = "utm_[a-z0-9_]+|gclid|dclid|fbclid|yclid|msclkid|igshid|mc_cid|mc_eid|ref|ref_src|ved|usg|sa|sxsrf|ei|gs_lcp|sourceid|ie|oe"


def part(u: str, group: int) -> str:
    return rf"regexp_extract({u}, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#\s]+)([^?#]*)(\?[^#]*)?', {group})"


def host(u: str) -> str:
    return f"lower(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1))"


def origin(u: str) -> str:
    return f"regexp_extract({u}, '^(https?)://', 1) || '://' || lower(regexp_extract({u}, '^https?://([^/?#]+)', 1))"


def bare(u: str) -> str:
    return rf"regexp_replace({host(u)}, '^www\.', '')"


def kept(u: str, keys: str) -> str:
    q = f"string_split(substr({part(u, 4)}, 2), '&')"
    return f"array_to_string(list_filter({q}, lambda x: not regexp_matches(split_part(x, '=', 1), '^(?i:{keys})$')), '&')"


def canonical(u: str) -> str:
    k = kept(u, TRACKING + "|source")
    path = f"regexp_replace({part(u, 3)}, '/+$', '')"
    body = f"lower({part(u, 1)}) || '://' || lower({part(u, 2)}) || case when {path} = '' then '/' else {path} end || case when {k} <> '' then '?' || {k} else '' end"
    return f"case when {part(u, 2)} <> '' then regexp_replace({body}, '/$', '') else {u} end"


def clean(u: str) -> str:
    k = kept(u, TRACKING)
    body = f"lower({part(u, 1)}) || '://' || lower({part(u, 2)}) || case when {part(u, 3)} = '' then '/' else {part(u, 3)} end || case when {k} <> '' then '?' || {k} else '' end"
    return f"case when {part(u, 2)} <> '' then case when regexp_matches({u}, '^(?i)https?://') then {body} else '' end else {u} end"


def below(h: str, target: str) -> str:
    return f"({h} = '{target}' or ends_with({h}, '.{target}'))"
