"""Secrets in texts, with multipart credential linking.

Base secrets (assignments, access identifiers, long hexadecimal strings) are reported as they are.
Weak parts are only candidates: something that looks like an account identifier, a random token, an
endpoint. They are joined by interval: a part's scope is the text up to ``SCOPE`` code points around
it, and a weak part is reported only if complementary parts lie in its scope - an identifier needs a
secret, a secret needs an identifier, an endpoint needs both.

Texts are independent, so this is one map over whole texts without a shuffle. The parts of a text
are sorted and joined by bisection, which is linear in what it reports.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from warpline.llm.common import text_batches

BASE, WEAK, SCOPE = ("assign", "access", "hex"), ("identifier", "token", "endpoint"), 300
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
# Runs are taken whole from their first character, so asking for the least length at once finds the same spans.
_ACCESS, _HEX = re.compile(r"AKIA[A-Z0-9]{16,}"), re.compile(r"[0-9a-f]{24,}")
_NAMED = ("access", "client", "account", "user", "login")
_IDENTIFIER = re.compile(r"""(?:access[_-]?(?:key[_-]?)?id|client[_-]?id|account[_-]?id|user(?:name|[_-]?id)?|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{4,}""", re.IGNORECASE | re.ASCII)
_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}")
_ADDRESS = re.compile(r"[a-z][a-z0-9+.-]{1,9}://[^\s\"'<>]+")
# Runs of the characters of host names are taken whole from their first one, which is linear; what a name is comes after.
_HOST_RUN = re.compile(r"(?<![a-z0-9.-])[a-z0-9.-]++:[0-9]{2,5}\b")

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    found: list[Span] = []
    lower = text.lower()
    if any(k in lower for k in _KEYWORDS):
        found += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return found


def _random(token: str) -> bool:
    """Letters and digits, as many different ones as a random token of the length would have."""
    counts = Counter(token)
    bits = -sum(n / len(token) * math.log2(n / len(token)) for n in counts.values())
    return bits >= 3.5 and any(c.isdigit() for c in token) and any(c.isalpha() for c in token)


class _Places:
    """Disjoint spans, sorted, to ask whether one overlaps a range."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.spans = sorted(spans)
        self.ends = [0] * len(spans)
        most = 0
        for i, (_, end) in enumerate(self.spans):
            self.ends[i] = most = max(most, end)

    def meet(self, start: int, end: int) -> bool:
        i = bisect_left(self.spans, (end,)) - 1
        return i >= 0 and self.ends[i] > start


def endpoints(text: str) -> list[tuple[int, int]]:
    """Addresses with a scheme, and names of two parts or more with a port that lie in none of them."""
    if ":" not in text:
        return []
    found = [m.span() for m in _ADDRESS.finditer(text)] if "://" in text else []
    taken = _Places(found)
    for m in _HOST_RUN.finditer(text):
        colon = m[0].rindex(":")
        begin = m[0].rfind("..", 0, colon) + 2 if ".." in m[0] else 0
        name = m[0][begin:colon].lstrip(".")
        start = m.start() + colon - len(name)
        if "." in name and not name.endswith(".") and not taken.meet(start, m.end()):
            found.append((start, m.end()))
    return sorted(found)


def linked_spans(text: str, base: list[Span], scope: int = SCOPE) -> list[Span]:
    """The weak parts of which complementary parts lie in scope; none overlaps a base span."""
    lower = text.lower()
    identifiers = [(s, e) for k, s, e in base if k == "access"]
    taken = _Places([(s, e) for _, s, e in base])
    weak_ids = [m.span() for m in _IDENTIFIER.finditer(text) if not taken.meet(*m.span())] if any(k in lower for k in _NAMED) else []
    if not identifiers and not weak_ids:
        return []
    named = _Places(identifiers + weak_ids)
    own = _Places([(s, e) for _, s, e in base] + weak_ids)
    tokens = [m.span() for m in _TOKEN.finditer(text) if not own.meet(*m.span()) and _random(m[0])]
    secrets = _Places([(s, e) for k, s, e in base if k != "access"] + tokens)
    near = lambda places, s, e: places.meet(s - scope, e + scope)
    found = [("identifier", s, e) for s, e in weak_ids if near(secrets, s, e)]
    found += [("token", s, e) for s, e in tokens if near(named, s, e)]
    ends = [e for e in endpoints(text) if not own.meet(*e)]
    return found + [("endpoint", s, e) for s, e in ends if near(named, s, e) and near(secrets, s, e)]


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """(id, spans): one row per row of ``docs`` with its spans as (kind, start, end) by start, then kind.

    Offsets are code points, the end exclusive; texts are read whole. Null and empty texts have no
    spans. Repeated rows and null ids stay, other columns are ignored, an empty table gives an empty
    result.
    """
    order = {k: i for i, k in enumerate(BASE + WEAK)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in text_batches(batches):
            rows = []
            for text in batch.column(1).to_pylist():
                base = base_spans(text or "")
                spans = base + linked_spans(text or "", base, scope)
                spans.sort(key=lambda s: (s[1], order[s[0]], s[2]))
                rows.append([{"kind": k, "start": s, "end": e} for k, s, e in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], names=[id_col, "spans"])

    slim = docs.select(id_col, text_col)
    return slim.mapInArrow(run, f"`{id_col}` {slim.schema[id_col].dataType.simpleString()}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def joined_spans(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
