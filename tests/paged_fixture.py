"""Fetcher of the paged source tests: three pages per query, the first call of each fails once."""

import json

_failed = set()


def fetch(query, token, page_size):
    if query == "broken":
        raise OSError("down")
    if query not in _failed:
        _failed.add(query)
        raise OSError("try again")
    page = int(token or 1)
    body = json.dumps({"query": query, "page": page, "size": page_size})
    return body, str(page + 1) if page < 3 else None
