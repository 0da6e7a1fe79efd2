"""Plain Python answers to the record problems, written from the problem statements, for comparison on small data."""

from __future__ import annotations

import datetime as dt
import json
import re
from collections import defaultdict
from statistics import median


def same(x):
    return None if x is None else x.strip(" ").lower()


def newest(rows, order):
    best = {}
    for r in rows:
        k = same(r["id"])
        if k is not None and (k not in best or (r[order] is not None and (best[k][order] is None or r[order] > best[k][order]))):
            best[k] = r
    return list(best.values())


def parse(text):
    def no(_):
        raise ValueError

    try:
        return json.loads(text, parse_constant=no)
    except (ValueError, TypeError):
        return None


def nested(text):
    out = []

    def walk(v, path, enc):
        if isinstance(v, dict):
            for k, x in v.items():
                if k == "config" and isinstance(x, str) and isinstance(y := parse(x), dict):
                    x = y
                walk(x, f"{path}.{k}" if path else k, enc)
        elif isinstance(v, list):
            for i, x in enumerate(v):
                p = f"{path}[{i}]"
                if isinstance(x, dict):
                    out.append((enc, p))
                    walk(x, p, p)
                else:
                    walk(x, p, enc)

    walk(parse(text), "", "$")
    return out


def p1(pipelines, nodes):
    out = set()
    for name, rows, order, col in (("pipelines", pipelines, "updated_at", "definition"), ("lineage_nodes", nodes, "created_at", "metadata")):
        for r in newest(rows, order):
            out |= {(name, r["id"], a, b) for a, b in nested(r[col])}
    return out


def _valid(kind, text):
    if kind == "integer":
        return bool(re.fullmatch(r"-?[0-9]+", text))
    if kind == "decimal":
        return bool(re.fullmatch(r"-?[0-9]+(\.[0-9]+)?", text))
    if kind == "boolean":
        return text.lower() in ("true", "false", "yes", "no", "1", "0")
    try:
        if kind == "date":
            return bool(re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", text)) and bool(dt.date.fromisoformat(text))
        if kind == "timestamp":
            return bool(re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}:[0-9]{2}", text)) and bool(dt.datetime.fromisoformat(text))
    except ValueError:
        return False
    return True


def _fields(record, sep):
    """The fields of a record, or None where a quote stands wrong."""
    out, i = [], 0
    while True:
        if record[i : i + 1] == '"':
            i, value = i + 1, ""
            while True:
                if i >= len(record):
                    return None
                if record[i] == '"':
                    if record[i + 1 : i + 2] == '"':
                        value, i = value + '"', i + 2
                        continue
                    i += 1
                    break
                value, i = value + record[i], i + 1
            if i < len(record) and record[i] != sep:
                return None
        else:
            end = record.find(sep, i)
            end = len(record) if end < 0 else end
            value, i = record[i:end], end
            if '"' in value:
                return None
        out.append(value)
        if i >= len(record):
            return out
        i += 1


def p2(files, schemas):
    kinds = defaultdict(list)
    for s in sorted(schemas, key=lambda s: s["position"]):
        kinds[s["schema_kind"]].append(s)
    bad, good = set(), {}
    for f in files:
        if not f["buffer"]:
            continue
        text = bytes(f["buffer"]).decode("latin-1" if "iso-8859-1" in (f["mimetype"] or "").lower() else "utf-8", "replace").lstrip("﻿")
        lines = re.split(r"\r?\n", text)
        sep = max(",;\t|", key=lines[0].count)
        records = []
        for no, line in enumerate(lines[1:], 2):
            if re.match(rf"[0-9]+{re.escape(sep)}", line):
                records.append([no, [line]])
            elif records:
                records[-1][1].append(line)
        for no, parts in records:
            while not parts[-1].strip():
                parts.pop()
            got, columns = _fields("\n".join(parts), sep), kinds[f["schema_kind"]]
            if got is None:
                bad.add((f["file_id"], no, "quoting"))
            elif len(got) != len(columns):
                bad.add((f["file_id"], no, "column_count"))
            elif any((c["required"] and not v.strip()) or (v.strip() and not _valid(c["data_type"], v.strip())) for c, v in zip(columns, got)):
                bad.add((f["file_id"], no, "invalid_value"))
            else:
                good[f["file_id"], no] = [v.strip() or None for v in got]
    return bad, good


def _state(parent, at):
    if parent is None:
        return "missing"
    created, deleted = parent
    if created is not None and at is not None and created > at:
        return "late"
    if deleted is not None and at is not None and deleted <= at:
        return "deleted"
    return None


def elements(v):
    return [x for x in v if isinstance(x, dict)] if isinstance(v, list) else []


def p3(notebooks, connections, edges, nodes, pipelines):
    out = []
    conns = {same(c["id"]): (c["created_at"], c["deleted_at"]) for c in connections}
    lines = {same(n["id"]): (n["created_at"], None) for n in nodes}
    for b in newest(notebooks, "updated_at"):
        for c in elements(parse(b["cells"])):
            to = c.get("connectionId")
            if isinstance(to, str) and to.strip() and (s := _state(conns.get(same(to)), b["updated_at"])):
                out.append(("notebooks", b["id"], c.get("id"), s))
    for e in newest(edges, "created_at"):
        if e["source"] and e["source"].strip() and (s := _state(lines.get(same(e["source"])), e["created_at"])):
            out.append(("lineage_edges", e["id"], "source", s))
    for p in newest(pipelines, "updated_at"):
        d = parse(p["definition"])
        if isinstance(d, dict):
            steps = {same(s.get("id")) for s in elements(d.get("steps")) if isinstance(s.get("id"), str)}
            for e in elements(d.get("edges")):
                to = e.get("target")
                if isinstance(to, str) and to.strip() and same(to) not in steps:
                    out.append(("pipelines", p["id"], e.get("id"), "missing"))
    return sorted(out, key=str)


def roots(names, edges):
    """names: key -> id as written; edges: (source key, target key). id -> (root, depth)."""
    up = {}
    for s, t in sorted(edges, reverse=True):
        if s in names and t in names:
            up[t] = s
    out = {}
    for k, name in names.items():
        at, depth, seen = k, 0, {k}
        while at in up:
            at, depth = up[at], depth + 1
            if at in seen:
                depth = -1
                break
            seen.add(at)
        out[name] = ("cycle", -1) if depth < 0 else (names[at], depth)
    return out


def p4(nodes, edges, pipelines):
    names = {}
    for n in nodes:
        names[same(n["id"])] = min(n["id"], names.get(same(n["id"]), n["id"]))
    out = {("lineage", k, *v) for k, v in roots(names, {(same(e["source"]), same(e["target"])) for e in edges if e["source"] and e["target"]}).items()}
    for p in newest(pipelines, "updated_at"):
        d = parse(p["definition"])
        if isinstance(d, dict):
            names = {same(s["id"]): s["id"] for s in elements(d.get("steps")) if isinstance(s.get("id"), str)}
            links = {(same(e["source"]), same(e["target"])) for e in elements(d.get("edges")) if isinstance(e.get("source"), str) and isinstance(e.get("target"), str)}
            out |= {(p["id"], k, *v) for k, v in roots(names, links).items()}
    return out


def p5(tables, profiles):
    out = set()
    for a in profiles:
        loads = defaultdict(list)
        for r in tables[a["table_name"]]:
            loads[r["load_no"]].append(r[a["column_name"]])
        for no, values in loads.items():
            full = [v for v in values if v is not None]
            name = (a["table_name"], no, a["column_name"])
            if abs(100 * (len(values) - len(full)) / len(values) - a["null_percent"]) > 8:
                out.add((*name, "null_rate"))
            if a["distinct_percent"] >= 90 and 100 * len(set(full)) / len(values) < a["distinct_percent"] - 10:
                out.add((*name, "distinct"))
            to = (lambda t: dt.datetime.fromisoformat(t.rstrip("Z"))) if a["data_type"] == "timestamp" else float
            if (a["min_value"] is not None and any(v < to(a["min_value"]) for v in full)) or (a["max_value"] is not None and any(v > to(a["max_value"]) for v in full)):
                out.add((*name, "range"))
            if a["value_pattern"] and full and 100 * sum(not re.search(a["value_pattern"], str(v)) for v in full) / len(full) > 2:
                out.add((*name, "pattern"))
            if a["median_value"] is not None and full and not a["median_value"] / 2 <= median(full) <= 2 * a["median_value"]:
                out.add((*name, "shift"))
    return out
