"""Rows of delimited files that fail to parse, set apart with their reasons.

Each schema and separator yields one anchored regular expression for a whole sound row.
Rows that do not match it pass through broader patterns, which give the reason, and through
patterns of growing prefixes, which give the first broken field. Everything is a literal
pattern inside the JVM; a file's lines never leave its row, so nothing is shuffled.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosslake.functions.common import Scratch, same_id

SEPARATORS = (",", ";", "\t", "|")
MOST_SCHEMA_COLUMNS = 20_000
JUDGED_COLUMNS = 64
PREFIX_FIELDS = 16

_DAY = (
    r"(?!0000)(?:[0-9]{4}-(?:(?:0[13578]|1[02])-(?:0[1-9]|[12][0-9]|3[01])|(?:0[469]|11)-(?:0[1-9]|[12][0-9]|30)|02-(?:0[1-9]|1[0-9]|2[0-8]))"
    r"|(?:[0-9]{2}(?:0[48]|[2468][048]|[13579][26])|(?:[02468][048]|[13579][26])00)-02-29)"
)
VALUES = {
    "integer": r"-?[0-9]++",
    "decimal": r"-?[0-9]++(?:\.[0-9]++)?",
    "boolean": r"(?i:true|false|yes|no|1|0)",
    "date": _DAY,
    "timestamp": _DAY + r"[ T](?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]",
}
FINER = r"\.[0-9]{10}[0-9]*[1-9]"  # digits that decimal(38,10) would round off
LOADED_AS = {"integer": "bigint", "decimal": "decimal(38,10)", "boolean": "boolean", "date": "date", "timestamp": "timestamp_ntz", "text": "string"}
_QUOTED = r'"[^"]*+(?:""[^"]*+)*+"'


def _any_field(sep: str) -> str:
    return rf'(?:{_QUOTED}|[^"{re.escape(sep)}]*+)'


def field_pattern(data_type: str, required: bool, sep: str) -> str:
    """The pattern of a sound field: quotes and blanks around the value do not matter."""
    s = re.escape(sep)
    blank = rf"[\s&&[^{s}]]"
    if data_type == "text":
        if not required:
            return _any_field(sep)
        return rf'(?:"\s*+(?:[^"\s]|"")[^"]*+(?:""[^"]*+)*+"|{blank}*+[^"{s}\s][^"{s}]*+)'
    value = VALUES[data_type]
    inner = rf"(?:{value})" if required else rf"(?:{value})?"
    return rf'(?:"\s*+{inner}\s*+"|{blank}*+{inner}{blank}*+)'


def row_patterns(columns: list[tuple[str, str, bool]], sep: str) -> dict[str, str | list[str]]:
    """Of one schema: the pattern of sound rows, of well-quoted rows, of rows with the right number of fields, and of prefixes.

    A prefix's fields but for the last PREFIX_FIELDS are skipped as any fields, since the
    prefixes before it tell of them; so the patterns of a wide schema stay short.
    """
    s, anything = re.escape(sep), _any_field(sep)
    fields = [field_pattern(t, need, sep) for _, t, need in columns]

    def prefix(k: int) -> str:
        skip = k // PREFIX_FIELDS * PREFIX_FIELDS
        return r"\A" + (rf"(?:{anything}{s}){{{skip}}}" if skip else "") + s.join(fields[skip : k + 1]) + rf"(?={s}|\z)"

    return {
        "sound": rf"\A{s.join(fields)}\z",
        "quoting": rf"\A{anything}(?:{s}{anything})*+\z",
        "count": rf"\A{anything}(?:{s}{anything}){{{len(fields) - 1}}}\z",
        "prefixes": [prefix(k) for k in range(len(fields))],
    }


def schemas_of(upload_schemas: DataFrame) -> dict[str, list[tuple[str, str, bool]]]:
    """kind: its columns (name, type, required) by position. Schemas are few; more than MOST_SCHEMA_COLUMNS is an error.

    Rows without kind or position describe no column; an unknown type is text.
    """
    rows = upload_schemas.select(same_id("schema_kind").alias("k"), "position", "column_name", F.lower(F.trim("data_type")).alias("t"), F.coalesce("required", F.lit(False)).alias("r")).dropDuplicates(["k", "position"]).limit(MOST_SCHEMA_COLUMNS + 1).collect()
    if len(rows) > MOST_SCHEMA_COLUMNS:
        raise ValueError(f"over {MOST_SCHEMA_COLUMNS} columns of schemas")
    out: dict[str, list[tuple[str, str, bool]]] = {}
    for r in sorted((r for r in rows if r.k is not None and r.position is not None), key=lambda r: (r.k, r.position)):
        out.setdefault(r.k, []).append((r.column_name or f"column_{r.position}", r.t if r.t in VALUES else "text", r.r))
    return out


def file_records(files: DataFrame) -> DataFrame:
    """The records of whole files: file_id, kind, sep, line_no, record.

    The text is UTF-8 (broken bytes become U+FFFD) unless ``mimetype`` names ISO-8859-1; a
    byte order mark is dropped; the separator is the one most frequent in the header line.
    A line of digits and a separator starts a record, other lines continue the one above;
    blank lines end no record and are dropped at its end. Null, empty and header-only
    buffers have no records. One row holds one file, so memory follows the largest file.
    """
    latin = F.coalesce(F.lower("mimetype").rlike(r"iso[-_ ]?8859-1(?![0-9])"), F.lit(False))
    text = F.when(latin, F.decode("buffer", "ISO-8859-1")).otherwise(F.make_valid_utf8(F.col("buffer").cast("string")))
    text = F.regexp_replace(text, "\\A(?:\ufeff|\u00ef\u00bb\u00bf)", "")
    df = files.where(F.length("buffer") > 0).select("file_id", same_id("schema_kind").alias("kind"), text.alias("text"))
    header = F.substring_index("text", "\n", 1)
    best = F.greatest(*[F.struct(F.regexp_count(header, F.lit(re.escape(s))).alias("n"), F.lit(-i).alias("i"), F.lit(s).alias("sep")) for i, s in enumerate(SEPARATORS)])
    df = df.withColumn("sep", best["sep"])
    # the outer transforms over one-element arrays bind the lines and the starts once for each file
    split = r"""
      transform(array(split(text, '\\r?\\n')), ls ->
        transform(array(filter(transform(ls, (l, i) -> if(i > 0 and regexp_extract(l, '^[0-9]+([,;|\\t])', 1) = sep, i, -1)), i -> i >= 0)), st ->
          transform(st, (s, k) -> struct(s + 1 as line_no, array_join(slice(ls, s + 1, coalesce(get(st, k + 1), size(ls)) - s), '\n') as record))
        )[0]
      )[0]"""
    rows = df.select("file_id", "kind", "sep", F.explode(F.expr(split)).alias("r"))
    return rows.select("file_id", "kind", "sep", F.col("r.line_no").cast("int").alias("line_no"), F.regexp_replace("r.record", r"(?:\n[^\S\n]*+)++\z", "").alias("record"))


def judge(records: DataFrame, schemas: dict[str, list[tuple[str, str, bool]]]) -> DataFrame:
    """Adds ``reason`` (null for sound rows: the first of quoting, column_count, invalid_value that applies) and ``field_no`` (from 0, the first broken field).

    The patterns stand in the plan, so kinds of up to JUDGED_COLUMNS columns together are
    judged by one expression; with more, the records are written once, by their part of the
    kinds, and each part is judged with its own patterns.
    """
    parts: list[dict] = [{}]
    for kind, columns in schemas.items():
        if parts[-1] and sum(map(len, parts[-1].values())) + len(columns) > JUDGED_COLUMNS:
            parts.append({})
        parts[-1][kind] = columns
    if len(parts) == 1:
        return _judge(records, schemas)
    of = F.create_map(*[F.lit(x) for i, p in enumerate(parts) for kind in p for x in (kind, i)])
    scratch = Scratch(records.sparkSession, "records")
    kept = scratch.write(records.withColumn("part_no", F.coalesce(F.try_element_at(of, F.col("kind")), F.lit(0))), "part_no")
    each = [_judge(kept.where(F.col("part_no") == i).drop("part_no"), p) for i, p in enumerate(parts)]
    return reduce(DataFrame.unionByName, each)


def _judge(records: DataFrame, schemas: dict[str, list[tuple[str, str, bool]]]) -> DataFrame:
    reason: Column = F.when(F.lit(False), F.lit(""))
    field: Column = F.when(F.lit(False), F.lit(0))
    rec = F.col("record")
    for kind, columns in schemas.items():
        for sep in SEPARATORS:
            p = row_patterns(columns, sep)
            here = (F.col("kind") == kind) & (F.col("sep") == sep)
            why = F.when(rec.rlike(p["sound"]), F.lit(None)).when(~rec.rlike(p["quoting"]), "quoting").when(~rec.rlike(p["count"]), "column_count").otherwise("invalid_value")
            at: Column = F.lit(len(columns))
            for k in reversed(range(len(columns))):
                at = F.when(~rec.rlike(p["prefixes"][k]), k).otherwise(at)
            reason, field = reason.when(here, why), field.when(here, at)
    known = F.coalesce(F.col("kind").isin(list(schemas)), F.lit(False))
    judged = records.withColumn("reason", F.when(known, reason).otherwise("unknown_schema"))
    return judged.withColumn("field_no", F.when(F.col("reason").isNotNull(), field))


def failing_records(files: DataFrame, upload_schemas: DataFrame) -> DataFrame:
    """One row for each failing record: file_id, line_no, reason, field_no, record.

    Files of a kind without schema have the reason ``unknown_schema``.
    """
    return judge(file_records(files), schemas_of(upload_schemas)).where("reason is not null").select("file_id", "line_no", "reason", "field_no", "record")


def sound_records(files: DataFrame, upload_schemas: DataFrame, kind: str) -> DataFrame:
    """The sound records of one kind with their types: file_id, line_no, the kind's columns, and unfit.

    Quotes and surrounding blanks are taken off; empty values are null. A value that its
    loaded type cannot hold as a whole (an integer or decimal with too many digits) is null
    in its column and stands as text in ``unfit``, a JSON object by column, null for records
    that fit. A schema column named file_id, line_no or unfit gets a leading underscore. A
    kind without schema has no sound records.
    """
    kind = kind.strip().lower()
    schemas = schemas_of(upload_schemas)
    if kind not in schemas:
        return files.select("file_id", F.lit(0).alias("line_no")).limit(0)
    good = judge(file_records(files).where(F.col("kind") == kind), {kind: schemas[kind]}).where("reason is null")
    parts: Column = F.when(F.lit(False), F.array(F.lit("")))
    for sep in SEPARATORS:
        parts = parts.when(F.col("sep") == sep, F.regexp_extract_all("record", F.lit(rf"(\A|{re.escape(sep)})({_any_field(sep)})"), F.lit(2)))
    out, unfit = [F.col("file_id"), F.col("line_no")], []
    for k, (name, kind_of, _) in enumerate(schemas[kind]):
        raw = F.get("parts", F.lit(k))
        v = F.when(raw.startswith('"'), F.replace(F.expr(f"substring(get(parts, {k}), 2, length(get(parts, {k})) - 2)"), F.lit('""'), F.lit('"'))).otherwise(raw)
        v = F.nullif(F.regexp_replace(v, r"\A\s++|\s++\z", ""), F.lit(""))
        to = f"_{name}" if name in ("file_id", "line_no", "unfit") else name
        if kind_of != "text":
            fits = v.try_cast(LOADED_AS[kind_of])
            if kind_of == "decimal":
                fits = F.when(~v.rlike(FINER), fits)
            unfit.append(F.when(v.isNotNull() & fits.isNull(), v).alias(to))
            v = fits
        out.append(v.alias(to))
    apart = F.nullif(F.to_json(F.struct(*unfit)), F.lit("{}")) if unfit else F.lit(None).cast("string")
    return good.withColumn("parts", parts).select(*out, apart.alias("unfit"))
