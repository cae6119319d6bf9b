"""Content hashes as other tools of the data model write them: XXH64 of texts, canonical JSON of any depth, narrative fingerprints."""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The name of this kind of hash in stored rows (fixed value).
HASH_VERSION = "xxh3-1"


def hexed(text: str) -> str:
    import xxhash

    return xxhash.xxh64_hexdigest(text.encode("utf-8", "surrogatepass"))


def utf16(key: str) -> bytes:
    """The order of texts by their UTF-16 code units."""
    return key.encode("utf-16-be", "surrogatepass")


def key_order(key: str):
    """The order of an object's keys: whole numbers first, ascending, then the others."""
    whole = key.isascii() and key.isdigit() and (key == "0" or key[0] != "0") and int(key) < (1 << 32) - 1
    return (0, int(key), b"") if whole else (1, 0, utf16(key))


def number(x: float) -> str:
    """A double as the shortest text that reads back, without a fraction where it has none, exponents from 1e21 and below 1e-6."""
    if x == int(x) and abs(x) < 1 << 53:
        return str(int(x))
    if abs(x) < 1e21 and x == int(x):  # the shortest digits, filled up with zeros
        figures, _, power = repr(x).lstrip("-").partition("e")
        figures = figures.removesuffix(".0").replace(".", "")
        return ("-" if x < 0 else "") + figures + "0" * (int(power) + 1 - len(figures) if power else 0)
    digits, _, exponent = repr(x).partition("e")
    if exponent:
        power = int(exponent)
        if -7 < power < 0:
            sign, body = ("-", digits[1:]) if digits[0] == "-" else ("", digits)
            return f"{sign}0.{'0' * (-power - 1)}{body.replace('.', '')}"
        return f"{digits.removesuffix('.0')}e{'+' if power > 0 else ''}{power}"
    if 0 < abs(x) < 1e-6:
        sign, body = ("-", digits[1:]) if digits[0] == "-" else ("", digits)
        figures = body.split(".")[1].lstrip("0")
        return f"{sign}{figures[0]}{'.' + figures[1:] if figures[1:] else ''}e-{len(body.split('.')[1]) - len(figures) + 1}"
    return digits


def canonical(value) -> str:
    """JSON without white space, the keys of every object in order."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical(value[k])}" for k in sorted(value, key=key_order)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    if not math.isfinite(value):
        raise ValueError("no finite number")
    return number(float(value))


def _refuse(text: str):
    raise ValueError(text)


def read_json(text: str):
    return json.loads(text, parse_constant=_refuse)


@F.pandas_udf(StringType())
def text_hash(texts: pd.Series) -> pd.Series:
    """XXH64 (seed 0) of a text as 16 hex digits; null of null."""
    return texts.map(lambda x: None if x is None else hexed(x)).astype(object)


@F.pandas_udf(StringType())
def canonical_json(texts: pd.Series) -> pd.Series:
    """F16: the canonical form of a JSON text of any depth; null where it is none, or holds a number that is not finite."""

    def one(x):
        try:
            return None if x is None else canonical(read_json(x))
        except (ValueError, OverflowError):
            return None

    return texts.map(one).astype(object)


@F.pandas_udf(StringType())
def narrative_hash(code: pd.Series, signature: pd.Series, role: pd.Series, callees: pd.Series, version: pd.Series) -> pd.Series:
    """The fingerprint of code, signature (or null), role (JSON text, null for none), callees (JSON object of keys and hashes) and prompt version.

    Null where code, callees or a prompt version that is not empty are missing, a hash is no text or empty, or JSON is none: no fingerprint then.
    """

    def one(c, s, r, m, v):
        try:
            hashes = None if m is None else read_json(m)
            if c is None or not v or not isinstance(hashes, dict) or not all(k and isinstance(h, str) and h for k, h in hashes.items()):
                return None
            pairs = [[k, hashes[k]] for k in sorted(hashes, key=utf16)]
            return hexed(canonical([c, s, None if r is None else read_json(r), pairs, v]))
        except (ValueError, OverflowError):
            return None

    return pd.Series([one(*x) for x in zip(code, signature, role, callees, version)], dtype=object)


def callee_summary_hashes(rows: DataFrame) -> DataFrame:
    """owner, conflict and callees (JSON object of keys and hashes of the summaries' texts) of rows (owner, symbol_key, summary).

    Equal rows count once; an owner with two texts for one key is a conflict and has no hashes. An empty summary is a text too, a null one is none.
    """
    hashed = rows.where("summary is not null and symbol_key <> ''").select("owner", "symbol_key", text_hash("summary").alias("h"))
    one = hashed.groupBy("owner", "symbol_key").agg(F.min("h").alias("h"), (F.min("h") != F.max("h")).alias("bad"))
    by = one.groupBy("owner").agg(F.max("bad").alias("conflict"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("symbol_key", "h")))).alias("m"))
    return by.select("owner", "conflict", F.when(~F.col("conflict"), F.to_json("m")).alias("callees"))
