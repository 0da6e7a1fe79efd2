"""Plain Python answers to the llm problems, written from the problem statements, for comparison on small data."""

from __future__ import annotations

from collections import defaultdict
from itertools import combinations

from tests.brute import same


def unique(rows):
    return list({same(r["id"]): r for r in rows if r["id"] is not None}.values())


def p7(history, shares, users, n=3):
    groups = defaultdict(list)
    for r in unique(history):
        if same(r["status"]) == "success" and r["execution_time_ms"] is not None and 1 <= r["execution_time_ms"] <= 86_400_000 and r["organization_id"]:
            groups["query_history", same(r["organization_id"]), r["executed_at"].strftime("%Y-%m")].append((-r["execution_time_ms"], r["executed_at"], same(r["id"]), r["id"]))
    orgs = {same(u["id"]): same(u["organization_id"]) for u in users if u["id"] is not None}
    for r in unique(shares):
        org = orgs.get(same(r["created_by"]))
        if r["active"] and org:
            groups["dataset_shares", org, r["created_at"].strftime("%Y-%m")].append((-r["access_count"], same(r["id"]), r["id"]))
    return [(k[0], x[-1]) for k, g in groups.items() for x in sorted(g)[:n]]


def p10(docs, span=200):
    where = defaultdict(set)
    for r in docs:
        t = r["text"] or ""
        for i in range(len(t) - span + 1):
            where[t[i : i + span]].add(r["doc_id"])
    return {p for ids in where.values() if len(ids) > 1 for p in combinations(sorted(ids), 2)}


def covered(docs, span=200):
    """doc_id -> number of characters in windows that another text has too."""
    where = defaultdict(set)
    for r in docs:
        t = r["text"] or ""
        for i in range(len(t) - span + 1):
            where[t[i : i + span]].add(r["doc_id"])
    out = {}
    for r in docs:
        t, on = r["text"] or "", set()
        for i in range(len(t) - span + 1):
            if len(where[t[i : i + span]]) > 1:
                on.update(range(i, i + span))
        out[r["doc_id"]] = len(on)
    return out


def runs(docs, span=200):
    """(doc_id, start, end) of the runs that lie in another text and cannot grow."""
    out = set()
    for r in docs:
        t, e = r["text"] or "", 0
        others = [o["text"] for o in docs if o["doc_id"] != r["doc_id"] and o["text"]]
        for s in range(len(t)):
            before = e
            e = max(e, s)
            near = [o for o in others if t[s:e] in o]
            while e < len(t) and (near := [o for o in near if t[s : e + 1] in o]):
                e += 1
            if e > before and e - s >= span:
                out.add((r["doc_id"], s, e))
    return out
