"""Secret scans that link the parts of a credential.

Three kinds are reported wherever they stand (``BASE``): assigned secrets, access identifiers and long hexadecimal runs.
Weak parts are common in clean texts: login names, short pass phrases, opaque runs of mixed letters and digits, addresses of
services.  A weak part is reported only if parts that complete it stand within ``REACH`` characters in the same scope, a run
of lines without an empty one between: an identifier needs a secret, a secret needs an identifier or an endpoint, an
endpoint needs both.  Intervals are joined inside each document by sorted sweeps, in time n log n of its parts: a part looks
up the nearest interval before and after it, no pair is formed, and nothing is shuffled.

Defined results: a null text is empty; texts of any length are read whole; of weak parts that overlap each other the kind
listed first stays, and none overlaps a base span; repeated rows come out as often as they come in; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkgauge.llm.common import no_null, slices

REACH = 400
_ANY_CASE = re.IGNORECASE | re.ASCII
# Kinds in the order of reports, their patterns, and which part of a credential they are.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", _ANY_CASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
LOGIN = re.compile(r"""\b(?:user(?:name)?|login|account|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@-]{3,})""", _ANY_CASE)
PHRASE = re.compile(r"""\b(?:pass|passphrase|pwd|pw|key|auth|credentials?)["']?\x20*[:=]\x20*["']?([^\s"',;]{4,})""", _ANY_CASE)
URI = re.compile(r"\b[a-z][a-z0-9+.-]*://(?:([^\s/:@\"'<>]+):([^\s/@\"'<>]+)@)?([^\s/@\"'<>]+)[^\s\"'<>]*", _ANY_CASE)
HOST = re.compile(r"""\b(?:host(?:name)?|server|endpoint|url)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)+(?::\d+)?)""", _ANY_CASE)
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_=-]*[0-9])(?=[A-Za-z0-9+/_=-]*[a-z])(?=[A-Za-z0-9+/_=-]*[A-Z])[A-Za-z0-9+/_=-]{16,}")
KINDS = ("assign", "access", "hex", "login", "phrase", "endpoint", "opaque")
BASE = KINDS[:3]
IDENTIFIERS, SECRETS, ENDPOINTS = ("access", "login"), ("assign", "hex", "phrase", "opaque"), ("endpoint",)
# A text without one of these words, in small letters, has no match of the pattern.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
LOGIN_WORDS = ("user", "login", "account", "client", "access")
PHRASE_WORDS = ("pass", "pwd", "pw", "key", "auth", "credential")
HOST_WORDS = ("host", "server", "endpoint", "url")
LEAST_ASSIGNED, LEAST_ACCESS = 6, 20
_EMPTY_LINE = re.compile(r"\n[\x20\t\r]*\n")

Span = tuple[int, int, str]


def base_spans(text: str, small: str) -> list[Span]:
    spans = []
    if any(w in small for w in ASSIGN_WORDS):
        spans += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m.group(2)) >= LEAST_ASSIGNED]
    if "AKIA" in text:
        spans += [(*m.span(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    return spans + [(*m.span(), "hex") for m in HEX.finditer(text)]


def weak_parts(text: str, small: str, base: list[Span]) -> list[Span]:
    """Weak parts that overlap neither base spans nor weak parts of a kind listed before."""
    found: list[Span] = []
    if any(w in small for w in LOGIN_WORDS):
        found += [(*m.span(1), "login") for m in LOGIN.finditer(text)]
    if any(w in small for w in PHRASE_WORDS):
        found += [(*m.span(1), "phrase") for m in PHRASE.finditer(text)]
    if "://" in text:
        for m in URI.finditer(text):
            found += [(*m.span(i), k) for i, k in ((1, "login"), (2, "phrase"), (3, "endpoint")) if m.group(i)]
    if any(w in small for w in HOST_WORDS):
        found += [(*m.span(1), "endpoint") for m in HOST.finditer(text)]
    # Opaque runs need an identifier or an endpoint to count.
    if any(k in (*IDENTIFIERS, *ENDPOINTS) for _, _, k in (*base, *found)):
        found += [(*m.span(), "opaque") for m in OPAQUE.finditer(text)]
    return without_overlaps(base, found) if found else found


def without_overlaps(base: list[Span], found: list[Span]) -> list[Span]:
    taken, out = sorted((a, b) for a, b, _ in base), []
    for kind in KINDS:
        furthest = list(accumulate((b for _, b in taken), max))
        new = []
        for a, b, _ in sorted({s for s in found if s[2] == kind}):
            before = bisect_left(taken, (b,))  # intervals that start before this one ends
            if (not before or furthest[before - 1] <= a) and (not new or new[-1][1] <= a):
                new.append((a, b))
        out += [(a, b, kind) for a, b in new]
        taken = sorted(taken + new)
    return out


class Nearest:
    """Looks up, among spans in one document, the nearest one to an interval."""

    def __init__(self, spans: list[Span]):
        self.spans = sorted(spans)
        self.starts = [s[0] for s in self.spans]
        # For each place the span that reaches furthest among those up to it.
        self.furthest = list(accumulate(self.spans, lambda x, y: max(x, y, key=itemgetter(1))))

    def within(self, start: int, end: int, low: int, high: int, reach: int) -> Span | None:
        """The nearest span in the scope ``low`` to ``high`` at most ``reach`` characters away."""
        at = bisect_left(self.starts, start)
        near = [self.furthest[at - 1]] if at else []
        near += self.spans[at : at + 1]
        gaps = [(max(s[0] - end, start - s[1], 0), s) for s in near if low <= s[0] and s[1] <= high]
        return min((g for g in gaps if g[0] <= reach), default=(0, None))[1]


def linked(text: str, base: list[Span], weak: list[Span], reach: int = REACH) -> list[tuple[Span, Span]]:
    """Weak parts that others complete, each with the nearest span that does."""
    cuts = [0, *[m.start() + 1 for m in _EMPTY_LINE.finditer(text)], len(text) + 1]
    roles = {name: Nearest([s for s in (*base, *weak) if s[2] in kinds])
             for name, kinds in (("identifier", IDENTIFIERS), ("secret", SECRETS), ("endpoint", ENDPOINTS))}
    out = []
    for start, end, kind in weak:
        at = bisect_left(cuts, start + 1)
        low, high = cuts[at - 1], cuts[at]

        def near(role: str) -> Span | None:
            return roles[role].within(start, end, low, high, reach)  # noqa: B023

        if kind in IDENTIFIERS:
            partner = near("secret")
        elif kind in SECRETS:
            partner = near("identifier") or near("endpoint")
        else:
            partner = near("secret") if near("identifier") else None
        if partner:
            out.append(((start, end, kind), partner))
    return out


def spans_of(text: str, reach: int = REACH) -> list[tuple[Span, Span | None]]:
    """All spans to report in their order, by start and then kind, with the partners of the linked ones."""
    small = text.lower()
    base = base_spans(text, small)
    weak = weak_parts(text, small, base)
    found = [(s, None) for s in base] + (linked(text, base, weak, reach) if weak else [])
    return sorted(found, key=lambda f: (f[0][0], KINDS.index(f[0][2])))


_SPAN = "struct<kind:string,start:int,end:int>"


def findings(docs: DataFrame, key: str = "doc_id", text: str = "text", reach: int = REACH) -> DataFrame:
    """Per row its key and ``spans``: kind, start and end in code points, and the ``partner`` of a linked weak part."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
        full = pa.struct([*kind, pa.field("partner", kind)])

        def row(span: Span, partner: Span | None = None) -> dict:
            return {"kind": span[2], "start": span[0], "end": span[1], "partner": partner and row(partner)}

        for batch in slices(batches, "body"):
            spans = [[row(*f) for f in spans_of(t.as_py(), reach)] for t in batch.column("body")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(spans, pa.list_(full))], ["id", "spans"])

    rows = docs.select(F.col(key).alias("id"), no_null(F.col(text).cast("string")).alias("body"))
    shape = T.StructType.fromDDL(f"spans array<struct<kind:string,start:int,end:int,partner:{_SPAN}>>")
    return rows.mapInArrow(work, T.StructType([rows.schema["id"], *shape])).withColumnRenamed("id", key)
