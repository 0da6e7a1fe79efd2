"""Deeply nested JSON records to related flat tables.

The texts of an Arrow batch are one byte buffer with offsets. A structural index of that
buffer (quotes, brackets, separators, scalars) gives every value its parent, its key or its
position; grammar is checked by one table of allowed neighbours over all tokens at once.
Rows, paths and parent links then come from takes on parent indices, level by level; no
text is parsed by itself.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosslake.functions.common import ship

OPEN_OBJ, CLOSE_OBJ, OPEN_ARR, CLOSE_ARR, COMMA, COLON, STRING, SCALAR = range(8)
_QUOTE, _ESCAPE, _BLANK, _OTHER = 8, 9, 10, 11
_CLASS = np.full(256, _OTHER, np.uint8)
for _i, _c in enumerate(b"{}[],:"):
    _CLASS[_c] = _i
_CLASS[ord('"')], _CLASS[ord("\\")] = _QUOTE, _ESCAPE
_CLASS[[9, 10, 13, 32]] = _BLANK

# states after a token, and the tokens that may follow
_ST_OBJ, _ST_ARR, _ST_COMMA_OBJ, _ST_COMMA_ARR, _ST_COLON, _ST_KEY, _ST_IN_OBJ, _ST_IN_ARR, _ST_TOP, _ST_BAD, _ST_START = range(11)
_VALUE = (OPEN_OBJ, OPEN_ARR, STRING, SCALAR)
_ALLOWED = np.zeros((11, 8), bool)
for _s, _t in {
    _ST_START: _VALUE, _ST_OBJ: (STRING, CLOSE_OBJ), _ST_ARR: (*_VALUE, CLOSE_ARR), _ST_COMMA_OBJ: (STRING,), _ST_COMMA_ARR: _VALUE,
    _ST_COLON: _VALUE, _ST_KEY: (COLON,), _ST_IN_OBJ: (COMMA, CLOSE_OBJ), _ST_IN_ARR: (COMMA, CLOSE_ARR),
}.items():
    _ALLOWED[_s, list(_t)] = True
_SCALAR = r"^(?:-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null)$"
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdefABCDEF")] = True
_AFTER_ESCAPE = np.zeros(256, bool)
_AFTER_ESCAPE[list(b'"\\/bfnrtu')] = True


def _gather(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The slices start:end of a byte buffer, as strings."""
    size = (end - start).astype(np.int64)
    offsets = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    at = np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[at])))


def _plain(texts: pa.Array) -> pa.Array:
    """The contents of JSON strings (given without their quotes), escapes resolved."""
    hit = pc.match_substring(texts, "\\")
    if not pc.any(hit).as_py():
        return texts
    odd = texts.filter(hit)
    fixed = json.loads('["' + '","'.join(odd.to_pylist()) + '"]')
    # a lone surrogate is legal in JSON but not in a text
    fixed = [x.encode("utf-16", "surrogatepass").decode("utf-16", "replace") for x in fixed]
    return pc.replace_with_mask(texts, hit, pa.array(fixed, pa.large_string()))


def _rank_in_group(group: np.ndarray) -> np.ndarray:
    """Of each element, how many before it have the same group."""
    order = np.argsort(group, kind="stable")
    g = group[order]
    first = np.r_[True, g[1:] != g[:-1]] if len(g) else np.zeros(0, bool)
    at = np.arange(len(g))
    out = np.empty(len(g), np.int64)
    out[order] = at - np.maximum.accumulate(np.where(first, at, 0)) if len(g) else at
    return out


def _index(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """(bytes, which rows are valid JSON, columns of the tokens of those rows)."""
    n = len(texts)
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offs = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    raw = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None and offs[-1] else np.zeros(0, np.uint8)
    size = np.diff(offs)
    start = offs[:-1] - offs[0] + np.arange(n)
    data = np.full(int(size.sum()) + n, 10, np.uint8)  # a line feed between rows ends every token
    data[np.arange(offs[-1] - offs[0]) + np.repeat(np.arange(n), size)] = raw[offs[0] : offs[-1]]
    bad = np.zeros(n, bool)
    row_of = lambda pos: np.searchsorted(start, pos, "right") - 1
    cls = _CLASS[data]

    escaped = np.zeros(0, np.int64)
    slash = np.flatnonzero(cls == _ESCAPE)
    if slash.size:
        at = np.arange(slash.size)
        first = np.maximum.accumulate(np.where(np.r_[True, np.diff(slash) != 1], at, 0))
        escaped = slash[(at - first) % 2 == 0] + 1
    quote = np.flatnonzero(cls == _QUOTE)
    if escaped.size:
        is_escaped = np.zeros(len(data) + 1, bool)
        is_escaped[escaped] = True
        quote = quote[~is_escaped[quote]]
    q_row = row_of(quote)
    odd = np.bincount(q_row, minlength=n) % 2 == 1 if n else bad
    bad |= odd
    keep = ~bad[q_row]
    quote, q_row = quote[keep], q_row[keep]
    opening, closing = quote[0::2], quote[1::2]  # an even number in every row that is left
    step = np.zeros(len(data) + 1, np.int8)
    step[opening] = 1
    step[closing + 1] -= 1
    inside = np.cumsum(step[:-1], dtype=np.int8).astype(bool)
    bad[row_of(np.flatnonzero((data < 32) & inside))] = True
    if escaped.size:
        e = escaped[inside[escaped - 1]]
        c = data[e]
        wrong = ~_AFTER_ESCAPE[c]
        u = e[c == ord("u")]
        bad[row_of(e[wrong])] = True
        if u.size:
            four = np.pad(data, (0, 4), constant_values=10)[u[:, None] + np.arange(1, 5)]
            bad[row_of(u[~_HEX[four].all(1)])] = True

    outside = ~inside
    struct = np.flatnonzero((cls <= COLON) & outside)
    other = np.flatnonzero(((cls == _OTHER) | (cls == _ESCAPE)) & outside)
    new = np.r_[True, np.diff(other) != 1] if other.size else np.zeros(0, bool)
    s_start = other[new]
    s_end = other[np.r_[new[1:], True]] + 1 if other.size else other
    pos = np.concatenate([struct, opening, s_start])
    typ = np.concatenate([cls[struct], np.full(len(opening), STRING, np.uint8), np.full(len(s_start), SCALAR, np.uint8)])
    end = np.concatenate([struct + 1, closing + 1, s_end])
    order = np.argsort(pos, kind="stable")
    pos, typ, end = pos[order], typ[order], end[order]
    row = row_of(pos)
    bad |= np.bincount(row, minlength=n) == 0

    is_scalar = typ == SCALAR
    if is_scalar.any():
        fits = pc.match_substring_regex(_gather(data, pos[is_scalar], end[is_scalar]), _SCALAR).to_numpy(zero_copy_only=False)
        bad[row[is_scalar][~fits]] = True
    d = np.where((typ == OPEN_OBJ) | (typ == OPEN_ARR), 1, np.where((typ == CLOSE_OBJ) | (typ == CLOSE_ARR), -1, 0))

    def narrow(*xs: np.ndarray) -> list[np.ndarray]:
        ok = ~bad[row]
        return [x[ok] for x in xs]

    def depth() -> np.ndarray:
        c = np.cumsum(d)
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if row.size else np.zeros(0, np.int64)
        base = (c - d)[first]
        return c - np.repeat(base, np.diff(np.r_[first, row.size]))

    if row.size:
        after = depth()
        last = np.r_[row[1:] != row[:-1], True]
        bad[row[after < 0]] = True
        bad[row[last][after[last] != 0]] = True
    pos, typ, end, d, row = narrow(pos, typ, end, d, row)
    level = depth() - (d == 1) if row.size else d
    parent = np.full(len(row), -1, np.int64)
    opens_at = np.flatnonzero(d == 1)
    by_level = opens_at[np.argsort(level[opens_at], kind="stable")]
    bounds = np.searchsorted(level[by_level], np.arange(int(level.max()) + 2)) if row.size else [0]
    toks = np.argsort(level, kind="stable")
    t_bounds = np.searchsorted(level[toks], np.arange(int(level.max()) + 2)) if row.size else [0]
    for k in range(1, len(t_bounds) - 1):
        mine, opens = toks[t_bounds[k] : t_bounds[k + 1]], by_level[bounds[k - 1] : bounds[k]]
        parent[mine] = opens[np.searchsorted(opens, mine) - 1]
    in_obj = (parent >= 0) & (typ[parent] == OPEN_OBJ)
    ctx = np.where(parent < 0, 2, np.where(in_obj, 0, 1))  # object, array, top
    prev = np.r_[255, typ[:-1]] if row.size else typ
    first = np.r_[True, row[1:] != row[:-1]] if row.size else np.zeros(0, bool)
    key = (typ == STRING) & in_obj & ((prev == OPEN_OBJ) | (prev == COMMA)) & ~first
    state = np.select(
        [typ == OPEN_OBJ, typ == OPEN_ARR, typ == COMMA, typ == COLON, key],
        [_ST_OBJ, _ST_ARR, np.array([_ST_COMMA_OBJ, _ST_COMMA_ARR, _ST_BAD])[ctx], np.array([_ST_COLON, _ST_BAD, _ST_BAD])[ctx], _ST_KEY],
        np.array([_ST_IN_OBJ, _ST_IN_ARR, _ST_TOP])[ctx],
    )
    before = np.where(first, _ST_START, np.r_[_ST_START, state[:-1]]) if row.size else state
    bad[row[~_ALLOWED[before, typ]]] = True

    ok = ~bad[row]
    new_at = np.cumsum(ok) - 1
    parent = np.where(parent >= 0, new_at[parent], -1)
    cols = {"pos": pos, "typ": typ, "end": end, "row": row, "level": level, "parent": parent, "in_obj": in_obj, "key": key}
    return data, ~bad, {k: v[ok] for k, v in cols.items()}


def _values(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, dict]:
    """(bytes, valid rows, the values of valid rows: row, level, parent value, key or position, type, slice)."""
    data, valid, t = _index(texts)
    is_val = np.isin(t["typ"], _VALUE) & ~t["key"]
    at = np.flatnonzero(is_val)
    to_val = np.cumsum(is_val) - 1
    v = {k: t[k][at] for k in ("pos", "end", "typ", "row", "level", "in_obj")}
    v["parent"] = np.where(t["parent"][at] >= 0, to_val[t["parent"][at]], -1)
    in_arr = (v["parent"] >= 0) & ~v["in_obj"]
    v["in_arr"], v["position"] = in_arr, np.full(len(at), -1, np.int64)
    v["position"][in_arr] = _rank_in_group(v["parent"][in_arr])
    k_at = at[v["in_obj"]] - 2
    keys = _plain(_gather(data, t["pos"][k_at] + 1, t["end"][k_at] - 1)).dictionary_encode()
    code = np.full(len(at), -1, np.int64)
    code[v["in_obj"]] = keys.indices.to_numpy()
    v["code"], v["keys"] = code, keys.dictionary
    # of members with the same key in one object the last one counts, with all that it holds
    m = np.flatnonzero(v["in_obj"])
    if m.size:
        pair = v["parent"][m] * (int(code.max()) + 1) + code[m]
        _, inv, count = np.unique(pair, return_inverse=True, return_counts=True)
        if (count > 1).any():
            newest = np.zeros(len(count), np.int64)
            np.maximum.at(newest, inv, m)
            gone = np.zeros(len(at), bool)
            gone[m[newest[inv] != m]] = True
            for k in range(1, int(v["level"].max()) + 1):
                mine = np.flatnonzero(v["level"] == k)
                gone[mine] |= gone[v["parent"][mine]]
            stay = ~gone
            to_new = np.cumsum(stay) - 1
            v = {k: x[stay] if isinstance(x, np.ndarray) else x for k, x in v.items()}
            v["parent"] = np.where(v["parent"] >= 0, to_new[v["parent"]], -1)
    return data, valid, v


def _join(*parts: pa.Array) -> pa.Array:
    return pc.binary_join_element_wise(*parts, pa.scalar("", pa.large_string()))


def flatten_texts(texts: pa.Array, embedded: tuple[str, ...] = ("config",), fields: bool = True) -> pa.Table:
    """All objects that are elements of arrays, at any depth, and each text's own object.

    Columns: row (index of the text), parent_path, node_path, table_path (the path without
    positions), position, and with ``fields`` the object's scalars as lists of names and
    values. The row of the text itself has node_path ``$`` and no parent. ``embedded`` names
    keys whose string value is read as the object it holds, if it holds one.
    """
    large = pa.large_string()
    blank = pa.scalar("", large)
    out: list[dict] = []
    leaves: list[tuple[np.ndarray, pa.Array, pa.Array]] = []
    base = {
        "row": np.arange(len(texts)), "path": pa.array([""] * len(texts), large), "general": pa.array([""] * len(texts), large), "rel": pa.array([""] * len(texts), large),
        "enc": np.full(len(texts), -1), "enc_path": pa.array(["$"] * len(texts), large),
    }
    n_nodes, depth = 0, 0
    while len(texts):
        data, valid, v = _values(texts)
        if depth:  # a text that holds no object stays the text that it is
            root_is_obj = np.zeros(len(texts), bool)
            root_is_obj[v["row"][(v["level"] == 0) & (v["typ"] == OPEN_OBJ)]] = True
            valid &= root_is_obj
            holds = valid[v["row"]]
            to_new = np.cumsum(holds) - 1
            v = {k: x[holds] if isinstance(x, np.ndarray) else x for k, x in v.items()}
            v["parent"] = np.where(v["parent"] >= 0, to_new[v["parent"]], -1)
            texts_left = np.flatnonzero(~valid)
            if fields and texts_left.size:
                take = pa.array(texts_left)
                leaves.append((base["enc"][texts_left], base["rel"].take(take), texts.take(take)))
        n = len(v["row"])
        levels = v["level"]
        order = np.argsort(levels, kind="stable")
        bounds = np.searchsorted(levels[order], np.arange(int(levels.max()) + 2)) if n else [0]
        local = np.empty(n, np.int64)
        local[order] = np.arange(n) - np.repeat(bounds[:-1], np.diff(bounds)) if n else 0
        enc = np.full(n, -1, np.int64)  # the node of the value itself, or else the nearest that encloses it
        up: dict = {}
        inner: list[tuple[np.ndarray, dict]] = []
        for k in range(len(bounds) - 1):
            mine = order[bounds[k] : bounds[k + 1]]
            if k == 0:
                r = pa.array(v["row"][mine])
                now = {c: base[c].take(r) for c in ("path", "general", "rel", "enc_path")}
                outer = base["enc"][v["row"][mine]]
                enc[mine] = outer
                if not depth:
                    made = np.arange(n_nodes, n_nodes + len(mine))
                    out.append({"row": base["row"][v["row"][mine]], "parent": pa.nulls(len(mine), large), "path": pa.array(["$"] * len(mine), large), "general": pa.array(["$"] * len(mine), large), "position": np.full(len(mine), -1), "up": np.full(len(mine), -1)})
                    enc[mine], n_nodes = made, n_nodes + len(mine)
                    is_node = np.zeros(len(mine), bool)
            else:
                up_at = pa.array(local[v["parent"][mine]])
                above = {c: x.take(up_at) for c, x in up.items()}
                arr = v["in_arr"][mine]
                named = np.where(arr, -1, v["code"][mine])
                name = pc.fill_null(v["keys"].take(pa.array(named, mask=named < 0)), blank)
                dot = pc.if_else(pa.array(~arr), pa.scalar(".", large), blank)
                at = pc.if_else(pa.array(arr), _join(pa.scalar("[", large), pa.array(v["position"][mine]).cast(large), pa.scalar("]", large)), blank)
                any_at = pc.if_else(pa.array(arr), pa.scalar("[]", large), blank)
                lead = lambda p: pc.if_else(pc.equal(p, blank), blank, dot)  # noqa: E731, B023
                now = {
                    "path": _join(above["path"], lead(above["path"]), name, at),
                    "general": _join(above["general"], lead(above["general"]), name, any_at),
                    "rel": _join(above["rel"], lead(above["rel"]), name, at),
                    "enc_path": above["enc_path"],
                }
                outer = enc[v["parent"][mine]]
                enc[mine] = outer
                is_node = arr & (v["typ"][mine] == OPEN_OBJ)
                if is_node.any():
                    here = np.flatnonzero(is_node)
                    sel = pa.array(here)
                    made = np.arange(n_nodes, n_nodes + len(here))
                    out.append({"row": base["row"][v["row"][mine[here]]], "parent": now["enc_path"].take(sel), "path": now["path"].take(sel), "general": now["general"].take(sel), "position": v["position"][mine[here]], "up": outer[here]})
                    enc[mine[here]], n_nodes = made, n_nodes + len(here)
                    mask = pa.array(is_node)
                    now["enc_path"] = pc.if_else(mask, now["path"], now["enc_path"])
                    now["rel"] = pc.if_else(mask, blank, now["rel"])
            kind = v["typ"][mine]
            text = kind == STRING
            code = v["code"][mine]
            if embedded:
                held = np.flatnonzero(np.isin(v["keys"].to_numpy(zero_copy_only=False), embedded))
                as_object = text & np.isin(code, held) & v["in_obj"][mine]
            else:
                as_object = np.zeros(len(mine), bool)
            if as_object.any():
                here = np.flatnonzero(as_object)
                inner.append((mine[here], {c: x.take(pa.array(here)) for c, x in now.items()}))
            if fields:
                here = np.flatnonzero(((kind == SCALAR) | text) & ~as_object)
                if here.size:
                    m = mine[here]
                    shrink = (kind[here] == STRING).astype(np.int64)
                    val = _gather(data, v["pos"][m] + shrink, v["end"][m] - shrink)
                    quoted = pa.array(shrink == 1)
                    plain = pc.if_else(quoted, val, pa.scalar(None, large))
                    hit = pc.fill_null(pc.match_substring(plain, "\\"), False)
                    if pc.any(hit).as_py():
                        val = pc.replace_with_mask(val, hit, _plain(val.filter(hit)))
                    val = pc.if_else(pc.and_(pc.invert(quoted), pc.equal(val, pa.scalar("null", large))), pa.scalar(None, large), val)
                    leaves.append((enc[m], now["rel"].take(pa.array(here)), val))
            up = now
        if not inner:
            break
        m = np.concatenate([x for x, _ in inner])
        texts = _plain(_gather(data, v["pos"][m] + 1, v["end"][m] - 1))
        base = {c: pa.chunked_array([x[c] for _, x in inner]).combine_chunks() for c in ("path", "general", "rel", "enc_path")} | {"row": base["row"][v["row"][m]], "enc": enc[m]}
        depth += 1
    cat = lambda k, t: pa.concat_arrays([x[k] if isinstance(x[k], pa.Array) else pa.array(x[k]) for x in out]).cast(t) if out else pa.array([], t)
    cols = {"row": cat("row", pa.int64()), "parent_path": cat("parent", large), "node_path": cat("path", large), "table_path": cat("general", large), "position": cat("position", pa.int64())}
    if fields:
        owner = np.concatenate([x for x, _, _ in leaves]) if leaves else np.zeros(0, np.int64)
        by = np.argsort(owner, kind="stable")
        offsets = np.searchsorted(owner[by], np.arange(n_nodes + 1)).astype(np.int32)
        take = pa.array(by)
        names = pa.concat_arrays([x for _, x, _ in leaves]).take(take) if leaves else pa.array([], large)
        vals = pa.concat_arrays([x for _, _, x in leaves]).take(take) if leaves else pa.array([], large)
        for name, x in (("field_names", names), ("field_values", vals)):
            cols[name] = pa.ListArray.from_arrays(pa.array(offsets), x.cast(pa.string()))
    return pa.table(cols)


def _pieces(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes, so that one batch's index stays small."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(size) // most
    cut = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip(np.r_[0, cut], np.r_[cut, len(size)]):
        if b > a:
            yield int(a), int(b)


def flatten_nested(
    df: DataFrame, id_col: str, json_col: str, embedded: tuple[str, ...] = ("config",), fields: bool = True, include_root: bool = False, tables: tuple[str, ...] | None = None, piece_bytes: int = 4 << 20
) -> DataFrame:
    """Every object that is an element of an array in ``json_col``, at any depth, as a row.

    Columns: root_id (``id_col`` as it stands), parent_path, node_path, table_path,
    position, and with ``fields`` the map ``fields`` of the object's scalars (nested
    objects by dotted names, elements of arrays by positions). ``tables`` keeps only
    these table paths; each is one flat table, whose parent rows are those with its
    parent_path. Texts that are null, empty or not valid JSON have no rows; of a key
    repeated in one object the last counts; columns other than the two given play no part.
    No shuffle: each partition is flattened where it lies, ``piece_bytes`` at a time.
    """
    ship(df.sparkSession)
    want = None if tables is None else pa.array(list(tables), pa.large_string())
    string = pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0), b.column(1).cast(pa.large_string())
            for lo, hi in _pieces(texts, piece_bytes):
                t = flatten_texts(texts.slice(lo, hi - lo), embedded, fields)
                keep = pc.is_valid(t["parent_path"]) if not include_root else pa.scalar(True)
                if want is not None:
                    keep = pc.and_(keep, pc.is_in(t["table_path"], want))
                if not (isinstance(keep, pa.Scalar)):
                    t = t.filter(keep)
                cols = {"root_id": ids.slice(lo, hi - lo).take(t["row"].combine_chunks() if t["row"].num_chunks != 1 else t["row"].chunk(0)).cast(string)}
                cols |= {c: t[c].cast(string).combine_chunks() for c in ("parent_path", "node_path", "table_path")}
                cols["position"] = t["position"].combine_chunks().cast(pa.int32())
                cols |= {c: t[c].combine_chunks() for c in t.column_names if c.startswith("field_")}
                yield pa.RecordBatch.from_pydict(cols)

    schema = "root_id string, parent_path string, node_path string, table_path string, position int"
    if fields:
        schema += ", field_names array<string>, field_values array<string>"
    got = df.select(F.col(id_col).alias("i"), F.col(json_col).alias("j")).where(F.col("i").isNotNull() & (F.length("j") > 0)).mapInArrow(run, schema)
    if fields:
        got = got.withColumn("fields", F.map_from_arrays("field_names", "field_values")).drop("field_names", "field_values")
    return got
