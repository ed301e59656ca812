"""Multipart credential linking (operator 2).

One pass over whole texts finds typed parts with their spans; an interval join then links parts of
complementary roles whose spans, widened by ``reach`` code points, overlap within one scope (a
document).  The join is a sweep over the scope's parts in start order, so a scope with very many
parts costs n log n and emits no pairs.

Parts:

* strong (always reported): ``assign``, ``access``, ``hex``;
* weak (reported only when linked): ``weak_access`` (a user or client id), ``weak_secret`` (a mixed
  run of 20+ code points of a key alphabet without a label, or a labelled value too short to stand
  alone), ``endpoint`` (a URL, a labelled host, or host:port: a name with a letter in it, an IPv4 or
  a bracketed IPv6 address; not within the value of another weak part).

Roles: access identifiers (access, weak_access), secrets (assign, hex, weak_secret), endpoints
(endpoint).  A secret is complemented by an identifier or an endpoint, each of these by a secret; a weak
part is reported when a part that complements it lies within reach, and it does not overlap a strong
part.  So a login name beside an address, without a secret, is prose and stays.

Defined cases: null and empty texts have no parts; repeated rows give repeated results; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import id_and_text, mapped

# The three base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # greedy runs: shorter ones can hold no longer match
HEX = re.compile(r"[0-9a-f]{16,}")  # likewise
ASSIGN_LEAST = 12

WEAK_ACCESS = re.compile(r"""(?:user(?:name|_?id)?|login|client_?id|account(?:_?id)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}""", re.IGNORECASE | re.ASCII)
WEAK_SECRET = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[a-z0-9+/_=-]*[A-Z])(?=[A-Z0-9+/_=-]*[a-z])[A-Za-z0-9+/_=-]{20,}(?![A-Za-z0-9+/_=-])", re.ASCII)
ENDPOINT = re.compile(r"(?:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|redis|mongodb|amqps?|s3|ftp)://[A-Za-z0-9.@:_~%/?#&=+-]{4,}", re.ASCII)
HOST = re.compile(r"""(?:(?<!local)host(?:_?name)?|server)["']?\x20*[:=]\x20*["']?(?:\[[0-9A-Fa-f:.]+\]|[A-Za-z0-9_.-]{2,})(?::[0-9]{1,5}(?![0-9]))?""", re.IGNORECASE | re.ASCII)
# Names of one label may not follow a colon and have ports of two digits or more.
HOST_PORT = re.compile(r"(?:\[[0-9A-Fa-f:.]{2,}\]:|(?<![A-Za-z0-9_.-])(?:[0-9]{1,3}(?:\.[0-9]{1,3}){3}:|(?=[A-Za-z0-9_-]*\.)(?=[0-9_.-]*[A-Za-z])[A-Za-z0-9_.-]++:|(?<!:)(?=[0-9_-]*[A-Za-z])[A-Za-z0-9_-]++:(?=[0-9]{2})))[0-9]{1,5}(?![A-Za-z0-9_]|[.:][0-9])", re.ASCII)

KINDS = ("assign", "access", "hex", "weak_access", "weak_secret", "endpoint")
ROLE = {"assign": 1, "access": 0, "hex": 1, "weak_access": 0, "weak_secret": 1, "endpoint": 2}
#: By role: identifiers and endpoints need a secret, secrets one of those.
COMPLEMENTS = ((1,), (0, 2), (1,))
#: An endpoint that holds a password itself.
USER_INFO = re.compile(r"//[^/\s@]*:[^/\s@]+@")
SCAN_SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_weak long, n_links long"


def base_parts(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(start, kind, end) of strong parts, and of labelled values too short to stand alone."""
    strong, short = [], []
    for m in ASSIGN.finditer(text):
        (strong if len(m[2]) >= ASSIGN_LEAST else short).append((m.start(), 0, m.end()))
    strong += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    strong += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(strong), short


def weak_parts(text: str, short: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    found = [(s, 4, e) for s, _, e in short]
    found += [(m.start(), 3, m.end()) for m in WEAK_ACCESS.finditer(text)]
    found += [(m.start(), 4, m.end()) for m in WEAK_SECRET.finditer(text)]
    values = sorted((s, e) for s, _, e in found)
    starts, most = [s for s, _ in values], list(accumulate((e for _, e in values), max))
    found += [(m.start(), 5, m.end()) for m in ENDPOINT.finditer(text)]
    found += [(m.start(), 5, m.end()) for m in HOST.finditer(text) if bisect_right(starts, m.start()) == bisect_left(starts, m.end())]
    for m in HOST_PORT.finditer(text):
        k = bisect_left(starts, m.end())
        if text[m.start() - 1 : m.start()] == "@" or not (k and most[k - 1] > m.start()):
            found.append((m.start(), 5, m.end()))
    return found


def interval_links(parts: list[tuple[int, int, int]], reach: int) -> tuple[list[bool], int]:
    """Which parts (in start order) have a complement within reach, and how many have.

    Each role keeps its parts' starts and running greatest end; a part [s, e) is linked to a role
    when one of that role's parts that start before e + reach ends after s - reach.
    """
    by_role: dict[int, tuple[list[int], list[int]]] = {}
    for s, kind, e in parts:
        starts, most = by_role.setdefault(ROLE[KINDS[kind]], ([], []))
        starts.append(s)
        most.append(max(e, most[-1]) if most else e)
    linked = []
    for s, kind, e in parts:
        hit = False
        for role in COMPLEMENTS[ROLE[KINDS[kind]]]:
            starts, most = by_role.get(role, ([], []))
            k = bisect_left(starts, e + reach)
            hit = hit or (k > 0 and most[k - 1] > s - reach)
        linked.append(hit)
    return linked, sum(linked)


def scan_text(text: str | None, reach: int) -> tuple:
    if not text:
        return 0, 0, 0, hashlib.sha256(b"").hexdigest(), "", 0, 0
    strong, short = base_parts(text)
    covered, weak = {}, []
    for part in weak_parts(text, short):
        covered.setdefault((part[0], part[2]), part)
    starts = [s for s, _, _ in strong]
    most = []
    for _, _, e in strong:
        most.append(max(e, most[-1]) if most else e)
    for part in covered.values():  # a weak part inside or across a strong one adds nothing
        k = bisect_left(starts, part[2])
        if not (k and most[k - 1] > part[0]):
            weak.append(part)
    every = sorted(strong + weak)
    linked, n_links = interval_links(every, reach)
    told = [p for p, is_linked in zip(every, linked, strict=True) if p[1] < 3 or is_linked]
    write = lambda rows: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in rows)
    count = [sum(1 for p in strong if p[1] == k) for k in range(3)]
    return *count, hashlib.sha256(write(strong).encode()).hexdigest(), write(told), len(told) - len(strong), n_links


#: A superset of the texts that can hold a reported part (endpoints need one of another role); one linear-time pass that drops most texts.
MAYBE = r"(?i)(password|passwd|secret|token|api_?key|user(name|_?id)?|login|client_?id|account(_?id)?)[\"']? *[:=]|AKIA[A-Z0-9]{14}|[0-9a-f]{16}|://|[A-Za-z0-9+/_=-]{20}"


def scan(docs: DataFrame, reach: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document, SCAN_SCHEMA; ``spans`` has base and linked weak spans in code points."""

    def find(batches):
        empty = scan_text("", reach)
        for batch in batches:
            text = batch.column(1)
            maybe = pc.fill_null(pc.match_substring_regex(text, MAYBE), False).to_pylist()
            rows = [scan_text(t.as_py(), reach) if m else empty for t, m in zip(text, maybe, strict=True)]
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_weak", "n_links"])

    return id_and_text(docs, id_col, text_col).mapInArrow(find, SCAN_SCHEMA)


def redact(docs: DataFrame, reach: int = 200, id_col: str = "doc_id", text_col: str = "text", mark: str = "[{kind}]") -> DataFrame:
    """``docs`` with every reported span replaced by a mark of its kind; other columns unchanged.

    An endpoint is replaced only if it holds a password.  Overlapping spans are merged and carry the
    first one's kind.  A null text stays null.
    """
    at = docs.columns.index(text_col)

    def clean(text: str) -> str:
        spans, out, done = scan_text(text, reach)[4], [], 0
        merged: list[list] = []
        for span in spans.split(",") if spans else []:
            kind, s, e = span.rsplit(":", 2)
            if kind == "endpoint" and not USER_INFO.search(text, int(s), int(e)):
                continue
            if merged and int(s) < merged[-1][2]:
                merged[-1][2] = max(merged[-1][2], int(e))
            else:
                merged.append([kind, int(s), int(e)])
        for kind, s, e in merged:
            out += [text[done:s], mark.format(kind=kind)]
            done = e
        return "".join([*out, text[done:]])

    def apply(batches):
        for batch in batches:
            text = batch.column(at)
            maybe = pc.fill_null(pc.match_substring_regex(text, MAYBE), False).to_pylist()
            if any(maybe):
                fixed = pa.array([clean(t.as_py()) if m else t.as_py() for t, m in zip(text, maybe, strict=True)], text.type)
                batch = pa.RecordBatch.from_arrays([fixed if k == at else c for k, c in enumerate(batch.columns)], batch.schema.names)
            yield batch

    return mapped(docs, apply)
