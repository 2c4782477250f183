"""Small row builders for hand-written estates."""

from datetime import datetime


def subject(i, **more):
    row = {
        "id": i, "external_id": i, "source": "aws_iam", "type": "human", "display_name": i, "status": "active",
        "created_at": datetime(2000, 1, 1), "ingest_seq": 0,
    }
    return {**row, **more}


def permission(i, actions=(), **more):
    row = {
        "id": i, "source": "aws_iam", "name": i, "type": "role", "actions": list(actions), "resources": [],
        "is_privileged": False, "risk_keywords": [], "permission_keys": [], "tags": [],
    }
    return {**row, **more}


def resource(i, sensitivity="low", **more):
    return {"id": i, "source": "aws_iam", "type": "x", "name": i, "sensitivity": sensitivity, **more}


def grant(s, p, **more):
    row = {"id": f"{s}/{p}/{more.get('n', 0)}", "subject_id": s, "permission_id": p, "source": "aws_iam", "is_active": True}
    more.pop("n", None)
    return {**row, **more}


def as_dict(df, key, value):
    return {r[key]: r[value] for r in df.select(key, value).collect()}


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.select(*columns).collect())
