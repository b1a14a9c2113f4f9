"""Secret scanning through a trigram inverted index (operator 7)."""

from __future__ import annotations

import re
from re import _constants as C
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import column, slices

#: Patterns in the common subset of Python's re (ASCII) and RE2.
RULES: dict[str, str] = {
    "aws_access_key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "github_token": r"\bgh[pousr]_[A-Za-z0-9]{36,255}\b",
    "slack_token": r"\bxox[abprs]-[A-Za-z0-9-]{10,250}",
    "google_api_key": r"\bAIza[0-9A-Za-z_-]{35}",
    "stripe_key": r"\b[rs]k_(?:live|test)_[0-9A-Za-z]{16,250}",
    "private_key": r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |ENCRYPTED )?PRIVATE KEY-----",
    "json_web_token": r"\beyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}",
    "assigned_credential": r"(?i)\b(?:password|passwd|secret|token|api_?key|access_?key)[ \t]*[:=][ \t]*[\"']?[0-9a-z_+/.-]{8,}",
    "url_credential": r"\b[a-z][a-z0-9+.-]{1,20}://[^ \t\n/:@]{1,100}:[^ \t\n/:@]{1,100}@",
    "bare_hex_key": r"\b[0-9a-f]{40}\b",
}
ALL = ("all",)
_MOST = 32


def trigram_query(pattern: str) -> tuple:
    """What the trigrams of any text that matches must satisfy: ("all",), ("tri", code), ("and", ...) or ("or", ...).

    Trigrams are of the UTF-8 bytes with ASCII letters in lower case.
    """
    return _sequence(list(_parser.parse(pattern, re.ASCII)))


def _join(kind: str, parts: list[tuple]) -> tuple:
    flat = []
    for p in parts:
        if p == ALL:
            if kind == "or":
                return ALL
            continue
        flat += p[1:] if p[0] == kind else [p]
    flat = list(dict.fromkeys(flat))
    return ALL if not flat else flat[0] if len(flat) == 1 else (kind, *flat)


def _of_strings(strings: set[bytes]) -> tuple:
    """Any of the strings occurs; each needs all its trigrams."""
    return _join("or", [_join("and", [("tri", s[i] << 16 | s[i + 1] << 8 | s[i + 2]) for i in range(len(s) - 2)]) for s in sorted(strings)])


def _sequence(items: list) -> tuple:
    needs, now = [], {b""}
    for op, arg in items:
        strings = _strings(op, arg)
        if strings is not None:
            if len(now) * len(strings) > _MOST:
                needs.append(_of_strings(now))
                now = {s[-2:] for s in now}
            if len(now) * len(strings) <= _MOST:
                now = {a + b for a in now for b in strings}
                continue
            strings = None
        needs.append(_of_strings(now))
        now = {b""}
        if op is C.SUBPATTERN:
            needs.append(_sequence(list(arg[3])))
        elif op is C.BRANCH:
            needs.append(_join("or", [_sequence(list(b)) for b in arg[1]]))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and arg[0] >= 1:
            needs.append(_sequence(list(arg[2])))
        elif op is C.ATOMIC_GROUP:
            needs.append(_sequence(list(arg)))
    needs.append(_of_strings(now))
    return _join("and", needs)


def _char(code: int) -> bytes:
    c = chr(code)
    return (c.lower() if code < 128 else c).encode("utf-8", "surrogatepass")


def _strings(op, arg) -> set[bytes] | None:
    """All strings the node can match, case folded, if they are few."""
    if op is C.LITERAL:
        return {_char(arg)}
    if op in (C.AT, C.ASSERT, C.ASSERT_NOT):
        return {b""}
    if op is C.IN:
        out: set[bytes] = set()
        for kind, value in arg:
            if kind is C.LITERAL:
                out.add(_char(value))
            elif kind is C.RANGE and value[1] - value[0] < 6:
                out |= {_char(v) for v in range(value[0], value[1] + 1)}
            else:
                return None
        return out if len(out) <= 6 else None
    if op is C.SUBPATTERN:
        return _product(list(arg[3]))
    if op is C.BRANCH:
        out = set()
        for b in arg[1]:
            s = _product(list(b))
            if s is None:
                return None
            out |= s
        return out if len(out) <= _MOST else None
    if op in (C.MAX_REPEAT, C.MIN_REPEAT) and (arg[:2] == (0, 1) or arg[0] == arg[1] and arg[0] <= 8):
        s = _product(list(arg[2]) * max(1, arg[1]))
        return None if s is None else s | {b""} if arg[0] == 0 else s
    return None


def _product(items: list) -> set[bytes] | None:
    out = {b""}
    for op, arg in items:
        s = _strings(op, arg)
        if s is None or len(out) * len(s) > _MOST:
            return None
        out = {a + b for a in out for b in s}
    return out


def wanted(query: tuple) -> set[int]:
    return set() if query == ALL else {query[1]} if query[0] == "tri" else set().union(*map(wanted, query[1:]))


def postings(buf: np.ndarray, offs: np.ndarray, needed: np.ndarray) -> dict[int, np.ndarray]:
    """For each needed trigram (a table over all codes), the sorted texts that hold it."""
    if len(buf) < 3:
        return {}
    b = np.where((buf >= 65) & (buf <= 90), buf + 32, buf).astype(np.int32)
    code = b[:-2] << 16
    code |= b[1:-1] << 8
    code |= b[2:]
    at = np.flatnonzero(needed[code])
    doc = np.searchsorted(offs, at, "right") - 1
    inside = at + 2 < offs[doc + 1]
    pair = np.unique(code[at[inside]].astype(np.int64) << 32 | doc[inside])
    tri = pair >> 32
    cut = np.flatnonzero(np.concatenate([[True], tri[1:] != tri[:-1]])) if len(tri) else np.zeros(0, np.int64)
    return {int(tri[a]): pair[a:z] & 0xFFFFFFFF for a, z in zip(cut, np.append(cut[1:], len(tri)))}


def candidates(query: tuple, index: dict[int, np.ndarray], n: int) -> np.ndarray:
    if query == ALL:
        return np.arange(n)
    if query[0] == "tri":
        return index.get(query[1], np.zeros(0, np.int64))
    parts = [candidates(q, index, n) for q in query[1:]]
    out = parts[0]
    for p in parts[1:]:
        out = np.intersect1d(out, p, assume_unique=True) if query[0] == "and" else np.union1d(out, p)
    return out


def scan(docs: DataFrame, rules: dict[str, str] | None = None) -> DataFrame:
    """Rows (doc_id, rule, n_matches, digest), one for each document and rule that matches.

    digest is the SHA-256 of the matches, in their order, joined by line feeds:
    results can be compared without copying secrets.  From each rule a Boolean
    query over trigrams is derived; every slice of documents gets an inverted
    index of the trigrams that any rule asks for, postings are intersected and
    united, and only the candidates are run through the regular expression, over their whole text.  A rule
    without mandatory trigrams is run over every text.  No shuffle takes place.

    Null and empty texts match nothing; a null doc_id is reported as null, a
    repeated row again; other columns are not read; an empty table gives no rows.
    """
    rules = RULES if rules is None else rules
    queries = {name: trigram_query(p) for name, p in rules.items()}
    kind = docs.schema["doc_id"].dataType.simpleString()

    def find(batches):
        import hashlib

        needed = np.zeros(1 << 24, bool)
        needed[sorted(set().union(*map(wanted, queries.values())))] = True
        compiled = {name: re.compile(p, re.ASCII) for name, p in rules.items()}
        for b in batches:
            ids, texts = column(b, "doc_id"), column(b, "text")
            for lo, hi, buf, offs in slices(texts):
                index = postings(buf, offs, needed)
                rows, names, counts, digests = [], [], [], []
                decoded: dict[int, str] = {}
                for name, query in queries.items():
                    for k in candidates(query, index, hi - lo).tolist():
                        text = decoded.get(k)
                        if text is None:
                            text = decoded[k] = texts[lo + k].as_py() or ""
                        found = [m.group() for m in compiled[name].finditer(text)]
                        if found:
                            rows.append(lo + k)
                            names.append(name)
                            counts.append(len(found))
                            digests.append(hashlib.sha256("\n".join(found).encode()).hexdigest())
                if rows:
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), pa.array(names), pa.array(counts, pa.int64()), pa.array(digests)], ["doc_id", "rule", "n_matches", "digest"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(find, f"doc_id {kind}, rule string, n_matches long, digest string")


def _sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    one = "SELECT doc_id, {0} AS rule, regexp_extract_all(text, {1}) AS found FROM documents"
    parts = " UNION ALL ".join(one.format(quoted(n), quoted(p)) for n, p in RULES.items())
    return f"SELECT doc_id, rule, len(found) AS n_matches, sha256(array_to_string(found, chr(10))) AS digest FROM ({parts}) WHERE len(found) > 0"


SQL = _sql()
