"""Leak scan and redaction."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.config import PATH_ROOTS

#: What the rules find. Fixed values.
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}\b"
BASE58 = "1-9A-HJ-NP-Za-km-z"
JOB = rf"(?i:\bjob[_ ]?id\s*[=:]\s*\d+|\bsubmitted batch job \d+|\bSLURM_JOB_ID=\d+)|ƒ[{BASE58}]{{4,}}"
FLUX = rf"\bf[{BASE58}]{{6,12}}\b"


def _path(roots) -> str:
    return rf"(?:^|[^A-Za-z0-9_$./~-])((?:{'|'.join(re.escape(r) for r in roots)})[^\s\"'`)\]>,;]+)"


def scan(records: DataFrame, id_col: str, text_col: str, usernames: tuple[str, ...] = (), roots=PATH_ROOTS, allow: tuple[str, ...] = ()) -> DataFrame:
    """``id, line_no, rule, found``: every match, lines from 1. Texts that can't match any rule are left out early."""
    line = F.col("line")
    lines = records.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, r"\r?\n", -1)).alias("k", "line"))
    quick = "@|(?i:job)|ƒ|" + FLUX + "|" + "|".join([*(re.escape(r) for r in roots), *(re.escape(u) for u in usernames)])
    lines = lines.where(line.rlike(quick))
    all_ = lambda pattern, group: F.regexp_extract_all(line, F.lit(pattern), F.lit(group))
    variable = lambda p: F.exists(F.array(*[F.lit(r) for r in roots if r.endswith("/")]), lambda r: p.startswith(F.concat(r, F.lit("$"))))
    found = {
        "leak/email": F.filter(all_(EMAIL, 0), lambda m: ~m.startswith("git@")),
        "leak/path": F.filter(all_(_path(roots), 1), lambda m: ~variable(m)),
        "leak/job-id": F.concat(all_(JOB, 0), F.filter(all_(FLUX, 0), lambda m: F.substring(m, 2, 20).rlike("[0-9]") & F.substring(m, 2, 20).rlike("[A-Z]"))),
    }
    if names := [u for u in usernames if len(u) >= 2]:
        found["leak/username"] = all_(rf"\b(?:{'|'.join(map(re.escape, names))})\b", 0)
    listed = F.flatten(F.array(*[F.transform(ms, _as(rule)) for rule, ms in found.items()]))
    out = lines.select("id", (F.col("k") + 1).cast("long").alias("line_no"), F.explode(listed).alias("m")).select("id", "line_no", "m.rule", "m.found")
    return out.where(~F.col("found").isin(*allow)) if allow else out


def _as(rule: str):
    return lambda m: F.struct(F.lit(rule).alias("rule"), m.alias("found"))


def redact(text: Column, usernames: tuple[str, ...] = (), home: str | None = None, roots=PATH_ROOTS) -> Column:
    """``text`` with matches replaced, leftmost and longest first, up to four times over. An Arrow UDF: replacements
    of several rules that overlap can't be put as one expression after another."""
    home_root = home.rstrip("/") + "/" if home and len(home) > 1 else None
    rules = [("<email>", re.compile(EMAIL), 0), ("<path>", re.compile(_path([*roots, *([home_root] if home_root else [])])), 1), ("<job-id>", re.compile(JOB), 0)]
    if names := [u for u in usernames if len(u) >= 2]:
        rules.insert(0, ("<user>", re.compile(rf"\b(?:{'|'.join(map(re.escape, names))})\b"), 0))
    flux = re.compile(FLUX)
    starts = tuple(r + "$" for r in roots if r.endswith("/"))

    def spans(line: str):
        for mark, pattern, group in rules:
            for m in pattern.finditer(line):
                found = m.group(group)
                if (mark == "<email>" and found.startswith("git@")) or (mark == "<path>" and found.startswith(starts)):
                    continue
                yield m.start(group), -m.end(group), "~/" + found[len(home_root) :] if mark == "<path>" and home_root and found.startswith(home_root) else mark
        for m in flux.finditer(line):
            tail = m.group()[1:]
            if any(c.isdigit() for c in tail) and any(c.isupper() for c in tail):
                yield m.start(), -m.end(), "<job-id>"

    def clean(line: str) -> str:
        for _ in range(4):
            out, at = [], 0
            for start, end, mark in sorted(spans(line)):
                if start >= at:
                    out += [line[at:start], mark]
                    at = -end
            if not out:
                break
            line = "".join(out) + line[at:]
        return line

    @F.pandas_udf("string")
    def redacted(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else "\n".join(map(clean, t.split("\n"))))

    return redacted(text)
