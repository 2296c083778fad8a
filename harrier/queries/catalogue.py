"""All queries of the library's own operators, and their SQL."""

from __future__ import annotations

from harrier.queries import inventory, lookups, policy, urls

QUERIES = {**urls.QUERIES, **policy.QUERIES, **inventory.QUERIES, **lookups.QUERIES}
SQL = {**urls.SQL, **policy.SQL, **inventory.SQL, **lookups.SQL}
flagship = policy.flagship
