"""Secret scans: every rule in one pass of one automaton, then exact places by each found rule's own."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from candela.llm.automaton import Automaton, Spans, finder
from candela.llm.common import importable

#: kind: (pattern, what a match of it must be to count). The first three are the base.
RULES = {
    "assign": (
        rb"(?i:(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+))",
        rb"(?i:(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]{6,}))",
    ),
    "access": (rb"AKIA[A-Z0-9]+", rb"AKIA[A-Z0-9]{16,}"),
    "hex": (rb"[0-9a-f]+", rb"[0-9a-f]{24,}"),
    "github": (rb"gh[pousr]_[A-Za-z0-9]+", rb"gh[pousr]_[A-Za-z0-9]{36,}"),
    "slack": (rb"xox[abprs]-[A-Za-z0-9-]+", rb"xox[abprs]-[A-Za-z0-9-]{10,}"),
    "pem": (rb"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----", rb"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----"),
}
BASE = ("assign", "access", "hex")
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
_COMPILED: dict = {}


class Rules:
    """Rules compiled: one automaton of all strict patterns, and for each rule those that tell a match's place and whether it counts."""

    def __init__(self, rules: dict[str, tuple[bytes, bytes]]):
        self.names = list(rules)
        self.all = finder([strict for _, strict in rules.values()])
        # A byte that ends every match of the strict patterns must end those of the patterns, too.
        within = finder([pattern for pattern, _ in rules.values()])
        self.all.resets = np.intersect1d(self.all.resets, within.resets)
        self.matches = [Spans(pattern) for pattern, _ in rules.values()]
        self.counts = [Automaton([strict], anchored=True) for _, strict in rules.values()]

    def spans(self, texts: list[bytes]) -> dict[int, list[tuple[int, int, int]]]:
        """For the texts that have any: (start, place of the rule, end) in code points, by start, then rule."""
        out: dict[int, list[tuple[int, int, int]]] = {}
        for i, k, low, high in self.all.hits(texts):
            part = texts[i][low:high]
            for a, b in self.matches[k].find(part):
                if self.counts[k].run(part[a:b]) == b - a:
                    out.setdefault(i, []).append((low + a, k, low + b))
        for i, own in out.items():
            if not texts[i].isascii():
                points = np.concatenate([[0], np.cumsum((np.frombuffer(texts[i], dtype=np.uint8) & 0xC0) != 0x80)])
                own = [(int(points[a]), k, int(points[b])) for a, k, b in own]
            out[i] = sorted(own)
        return out


def compiled(rules: dict[str, tuple[bytes, bytes]]) -> Rules:
    """Compiled once in each worker."""
    key = tuple((k, *x) for k, x in rules.items())
    if key not in _COMPILED:
        _COMPILED[key] = Rules(rules)
    return _COMPILED[key]


def scan(docs: DataFrame, rules: dict | None = None) -> DataFrame:
    """Secrets of all documents: doc_id, counts by base kind, base_sha256 and spans (kind:start:end, ...).

    docs: doc_id, text. rules: kind: (pattern, strict pattern), over bytes; a rule's matches are leftmost, of these longest, and
    don't overlap; those that its strict pattern doesn't match whole are dropped. One automaton of all strict patterns, whose long
    repeats it counts as far as its states reach, reads each byte once, however many rules there are and however long a text is; between the bytes that end every match around what it
    finds, a rule's own two automata tell the exact places. Null and empty texts have no spans; rows that share a doc_id are
    scanned each; an empty table gives no row. No row moves.
    """
    importable(docs.sparkSession)
    default = rules is None

    def run(frames):
        import pandas as pd

        from candela.llm import secrets, tokens

        known = secrets.compiled(secrets.RULES if default else rules)
        names = known.names
        for frame in frames:
            for pdf in tokens.slices(frame):
                texts = [x.encode() if isinstance(x, str) else b"" for x in pdf["text"]]
                rows, found = [], known.spans(texts)
                for i, doc in enumerate(pdf["doc_id"]):
                    said = [(names[k], f"{names[k]}:{a}:{b}") for a, k, b in found.get(i, ())]
                    count = [sum(k == base for k, _ in said) for base in BASE]
                    rows.append((doc, *count, hashlib.sha256(",".join(x for k, x in said if k in BASE).encode()).hexdigest(), ",".join(x for _, x in said)))
                yield pd.DataFrame(rows, columns=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]).astype({"doc_id": "Int64"})

    return docs.select("doc_id", "text").mapInPandas(run, SCHEMA)
