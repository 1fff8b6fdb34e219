"""Hand-made search pages."""

import json
import os
from pathlib import Path


def node(id, **changes):
    full = {
        "id": id,
        "name": f"name {id}",
        "description": "text",
        "forkCount": 3,
        "isFork": True,
        "isArchived": False,
        "isLocked": False,
        "createdAt": "2019-03-04T05:06:07Z",
        "pushedAt": "2020-03-04T05:06:07Z",
        "primaryLanguage": {"name": "Python"},
        "assignableUsers": {"totalCount": 2},
        "stargazers": {"totalCount": 10},
        "watchers": {"totalCount": 4},
        "issues": {"totalCount": 5},
        "pullRequests": {"totalCount": 6},
        "repositoryTopics": {"edges": [{"node": {"topic": {"name": n}}} for n in ("a", "b")]},
        "licenseInfo": {"key": "mit"},
        "commits": {"history": {"totalCount": 7}},
        "readme": {"text": "# Title"},
    }
    return full | changes


def page(*nodes, more=False, cursor=None, period=None, seq=None):
    document = {
        "data": {
            "search": {
                "edges": [{"node": n} for n in nodes],
                "pageInfo": {"hasNextPage": more, "endCursor": cursor},
            }
        }
    }
    if period:
        document["period"] = {"startdate": period[0], "enddate": period[1]}
    if seq is not None:
        document["seq"] = seq
    return document


_moment = [1_600_000_000]


def land(folder, name, *documents):
    """One file per call, each later than the one before."""
    path = Path(folder) / name
    path.write_text("\n".join(d if isinstance(d, str) else json.dumps(d) for d in documents) + "\n")
    _moment[0] += 10
    os.utime(path, (_moment[0], _moment[0]))
