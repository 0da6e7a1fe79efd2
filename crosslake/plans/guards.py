"""Predicates over SQL text, auto-limit, and what a text tells of its tables and operations."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from crosslake.model import EngineConfig

# The texts each guard refuses.
QUERY_COMMENTS = ("--", "/*", "*/")
QUERY_PATTERNS = (
    r";\s*(drop|delete|truncate|alter|create|grant|revoke)\s+",
    r"xp_cmdshell",
    r"sp_executesql",
    r"exec(\s+|\()",
    r"execute(\s+|\()",
    r"into\s+outfile",
    r"into\s+dumpfile",
    r"load_file",
)
STAGING_WORDS = ("drop", "delete", "truncate", "update", "insert", "alter", "create", "grant", "revoke")
SHARE_PATTERNS = (
    r";\s*(drop|delete|insert|update|alter|create|truncate|grant|revoke)",
    r"--",
    r"/\*",
    r"xp_cmdshell",
    r"exec\s*\(",
    r"execute\s*\(",
    r"script",
)
GENERATED_PATTERNS = (
    r"\bDROP\s+(TABLE|DATABASE|SCHEMA|INDEX|VIEW|FUNCTION|PROCEDURE)\b",
    r"\bTRUNCATE\s+TABLE\b",
    r"\bALTER\s+(TABLE|DATABASE|SCHEMA)\b",
    r"\bCREATE\s+(TABLE|DATABASE|SCHEMA|INDEX|VIEW|FUNCTION|PROCEDURE)\b",
    r"\bGRANT\b",
    r"\bREVOKE\b",
    r"\bEXEC(UTE)?\s*\(",
    r"\bSHUTDOWN\b",
    r"\bKILL\b",
    r"xp_cmdshell",
    r";\s*(DROP|TRUNCATE|DELETE|UPDATE|INSERT)",
)
WHERE_PATTERNS = (r";\s*(drop|delete|update|insert|create|alter)", r"--", r"/\*", r"xp_")
OPERATION_WORDS = ("SELECT", "WHERE", "JOIN", "GROUP BY", "ORDER BY", "LIMIT", "HAVING")


class UnsafeSql(ValueError):
    """A guard refused the text."""


def _hit(patterns: tuple[str, ...], sql: str) -> str | None:
    return next((p for p in patterns if re.search(p, sql, re.IGNORECASE)), None)


def is_safe_query(sql: object) -> bool:
    """The guard of queries and transformations. It does not ask for SELECT."""
    if not isinstance(sql, str) or not sql:
        return False
    return not any(c in sql for c in QUERY_COMMENTS) and _hit(QUERY_PATTERNS, sql) is None


def check_staging_query(sql: str, schema: str) -> None:
    if _hit(tuple(rf"\b{w}\s+" for w in STAGING_WORDS), sql):
        raise UnsafeSql("Staging tables can only be read")
    if schema.lower() not in sql.lower():
        raise UnsafeSql(f"The text names no table of {schema}")


def check_share_query(sql: str) -> None:
    if not isinstance(sql, str) or not sql:
        raise UnsafeSql("No SQL given")
    if not sql.lower().strip().startswith("select"):
        raise UnsafeSql("A share takes texts that begin with SELECT")
    if _hit(SHARE_PATTERNS, sql):
        raise UnsafeSql("Refused: the text has a pattern that shares do not take")
    semicolons = sql.count(";")
    if semicolons > 1 or (semicolons == 1 and not sql.strip().endswith(";")):
        raise UnsafeSql("One statement at a time")


def check_where(text: str) -> None:
    if _hit(WHERE_PATTERNS, text):
        raise UnsafeSql("Refused: the condition holds more than a condition")


@dataclass
class Validation:
    is_valid: bool
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    sanitized: str | None = None


def operation_of(sql: str) -> str | None:
    head = sql.strip().upper()
    for words, op in ((("SELECT", "WITH"), "SELECT"), (("INSERT",), "INSERT"), (("UPDATE",), "UPDATE"), (("DELETE",), "DELETE")):
        if head.startswith(words):
            return op
    return None


def sanitize(sql: str) -> str:
    """The text without comments, its blanks collapsed."""
    return re.sub(r"\s+", " ", re.sub(r"/\*[\s\S]*?\*/", "", re.sub(r"--[^\n]*", "", sql))).strip()


def validate_generated(sql: str, config: EngineConfig) -> Validation:
    """The guard of generated SQL, with the organization's settings."""
    if not config.sql_validation_enabled:
        return Validation(True, warnings=["Not checked: the guard is switched off"])
    errors = [f"Refused pattern: {p}" for p in GENERATED_PATTERNS if re.search(p, sql, re.IGNORECASE)]
    warnings = []
    op = operation_of(sql)
    if op is None:
        errors.append("Neither SELECT, INSERT, UPDATE nor DELETE")
    elif op not in config.allowed_sql_operations:
        errors.append(f"{op} is not among the operations taken: {', '.join(config.allowed_sql_operations)}")
    if op == "SELECT":
        m = re.search(r"\bLIMIT\s+(\d+)", sql, re.IGNORECASE)
        if not m:
            warnings.append(f"No LIMIT: at most {config.max_rows_limit} rows come back")
        elif int(m[1]) > config.max_rows_limit:
            warnings.append(f"LIMIT {m[1]} is above {config.max_rows_limit}, the most rows that come back")
    if sum(bool(s.strip()) for s in sql.split(";")) > 1:
        errors.append("More than one statement")
    if re.search(r"--.*(\bOR\b|\bAND\b)", sql, re.IGNORECASE):
        errors.append("A comment that holds AND or OR")
    if re.search(r"\bUNION\s+(ALL\s+)?SELECT\b", sql, re.IGNORECASE):
        warnings.append("Holds a UNION")
    return Validation(not errors, errors, warnings, sanitize(sql))


def add_limit(sql: str, limit: int) -> str:
    """SELECT and WITH texts without LIMIT get one; a final semicolon stays."""
    if operation_of(sql) != "SELECT" or re.search(r"\bLIMIT\s+\d+", sql, re.IGNORECASE):
        return sql
    text = sql.strip()
    return f"{text[:-1]} LIMIT {limit};" if text.endswith(";") else f"{text} LIMIT {limit}"


def tables_in(sql: str) -> list[str]:
    """The names after FROM, then those after JOIN, without quotes, each once."""
    names = [m for word in ("FROM", "JOIN") for m in re.findall(rf'\b{word}\s+([a-zA-Z0-9_."]+)', sql, re.IGNORECASE)]
    return list(dict.fromkeys(n.replace('"', "") for n in names))


def operations_in(sql: str) -> list[str]:
    return [w for w in OPERATION_WORDS if w in sql.upper()]


def sql_from_answer(text: str) -> tuple[str, str | None]:
    """(SQL, reasoning) out of a free text: a fenced block, else the part from SELECT or WITH on."""
    reasoning = m[1].strip() if (m := re.search(r"REASONING:\s*(.+)", text, re.IGNORECASE | re.DOTALL)) else None
    body = re.split(r"REASONING:", text, maxsplit=1, flags=re.IGNORECASE)[0]
    if m := re.search(r"```(?:sql)?\s*(.+?)```", body, re.IGNORECASE | re.DOTALL):
        return m[1].strip(), reasoning
    m = re.search(r"\b(?:SELECT|WITH)\b.+", body, re.IGNORECASE | re.DOTALL)
    return (m[0] if m else body).strip(), reasoning
