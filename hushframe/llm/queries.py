"""All queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import containment, html_text, lines, near_dup, pieces, quality, shards, substring, url_rules, warc

MODULES = (url_rules, quality, substring, pieces, warc, html_text, shards, near_dup, lines, containment)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
SQL = {name: sql for m in MODULES for name, sql in m.SQL.items()}
