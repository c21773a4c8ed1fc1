"""Secret scans over a trigram inverted index.

Each rule's regular expression gives a Boolean query of trigrams that any match must contain (after Cox, 2012):
alternatives are OR-ed, what follows one another is AND-ed. Every block of texts is indexed by the trigrams
that some rule asks for; postings are intersected and united as the query says, and the rule's expression
verifies the candidates on the whole text. A rule without a mandatory trigram scans every text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as C
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.shared import STEP_BYTES, as_bytes, small_batches, steps

#: A query: True (says nothing), a trigram, or ("and" | "or", queries).
Query = bool | bytes | tuple
#: Strings that a part of an expression may be spelled out as.
SPELLED = 32


@dataclass(frozen=True)
class Rule:
    """group: the group of at least min_length characters; shorter matches are dropped."""

    kind: str
    pattern: str
    group: int = 0
    min_length: int = 1


#: Fixed by contract. Runs of hexadecimal digits are maximal, so those of 24 and more are matched directly.
BASE = (
    Rule("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
EXTRA = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_bot", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("map_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("payment", r"[sr]k_live_[0-9A-Za-z]{16,}"),
)


def _all(parts: list[Query]) -> Query:
    parts = [p for p in dict.fromkeys(parts) if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _any(parts: list[Query]) -> Query:
    parts = list(dict.fromkeys(parts))
    return True if not parts or True in parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _required(strings: set[str]) -> Query:
    """What a text must hold that holds one of the strings; letters are folded to lower case as in the index."""
    def one(s: str) -> Query:
        raw = s.encode().lower()
        return _all([raw[i : i + 3] for i in range(len(raw) - 2)])

    return _any([one(s) for s in sorted(strings)])


def _walk(items, flags: int) -> tuple[set[str] | None, Query]:
    """Strings that a sequence of parsed items spells out, if few, and its query otherwise."""
    spelled: set[str] | None = {""}
    found: list[Query] = []
    whole = True
    for op, arg in items:
        options, query = _item(op, arg, flags)
        if options is not None and len(spelled) * len(options) <= SPELLED:
            spelled = {a + b for a in spelled for b in options}
            continue
        whole = False
        found.append(_required(spelled))
        spelled = options if options is not None and len(options) <= SPELLED else {""}
        if options is None:
            found.append(query)
    return (spelled, True) if whole else (None, _all([*found, _required(spelled)]))


def _sure(letters: set[str], flags: int) -> bool:
    """Whether a match shows the letters but for the case of A-Z. With case ignored beyond ASCII, i, k and s also
    match letters outside it, and those outside match others of different bytes."""
    if not flags & re.IGNORECASE or flags & re.ASCII:
        return True
    return all(c.isascii() and c not in "iksIKS" for c in letters)


def _item(op, arg, flags: int) -> tuple[set[str] | None, Query]:
    if op is C.LITERAL:
        return ({chr(arg)}, True) if _sure({chr(arg)}, flags) else (None, True)
    if op is C.IN and all(k is C.LITERAL for k, _ in arg) and len(arg) <= 6:
        letters = {chr(v) for _, v in arg}
        return (letters, True) if _sure(letters, flags) else (None, True)
    if op is C.SUBPATTERN:
        return _walk(arg[3], (flags | arg[1]) & ~arg[2])
    if op is C.BRANCH:
        parts = [_walk(x, flags) for x in arg[1]]
        if all(s is not None for s, _ in parts) and len(union := set().union(*(s for s, _ in parts))) <= SPELLED:
            return union, True
        return None, _any([q if s is None else _required(s) for s, q in parts])
    if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
        low, high, body = arg
        options, query = _walk(body, flags)
        if low == 0:
            return ({""} | options, True) if options is not None and high == 1 else (None, True)
        return None, query if options is None else _required(options)
    if op is C.AT:
        return {""}, True
    return None, True


def trigram_query(pattern: str) -> Query:
    parsed = _parser.parse(pattern)
    strings, query = _walk(parsed, parsed.state.flags)
    return query if strings is None else _required(strings)


def trigrams(query: Query) -> set[bytes]:
    return set() if query is True else {query} if isinstance(query, bytes) else set().union(*map(trigrams, query[1]))


def _candidates(query: Query, postings: dict[bytes, np.ndarray]) -> np.ndarray:
    if isinstance(query, bytes):
        return postings[query]
    sets = [_candidates(q, postings) for q in query[1]]
    out = sets[0]
    for x in sets[1:]:
        out = np.intersect1d(out, x, assume_unique=True) if query[0] == "and" else np.union1d(out, x)
    return out


class Index:
    """The rules, ready to search blocks of texts."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = [(i, r, re.compile(r.pattern), trigram_query(r.pattern)) for i, r in enumerate(rules)]
        self.grams = sorted(set().union(*(trigrams(q) for *_, q in self.rules)))
        self.codes = np.array([g[0] << 16 | g[1] << 8 | g[2] for g in self.grams], dtype=np.uint32)
        self.asked = np.zeros(1 << 24, dtype=bool)
        self.asked[self.codes] = True
        self.fold = np.arange(256, dtype=np.uint32)
        self.fold[65:91] += 32

    def postings(self, texts: list[bytes]) -> dict[bytes, np.ndarray]:
        """The texts that hold each trigram; of a long text, piece by piece."""
        parts: dict[bytes, list[np.ndarray]] = {g: [] for g in self.grams}
        for i, text in enumerate(texts):
            if len(text) > STEP_BYTES:  # pieces overlap by two bytes
                held = set()
                for a in range(0, len(text), STEP_BYTES):
                    held |= {g for g, found in self._postings([text[a : a + STEP_BYTES + 2]]).items() if len(found)}
                for g in held:
                    parts[g].append(np.array([i]))
        short = [i for i, t in enumerate(texts) if len(t) <= STEP_BYTES]
        if short:
            for g, found in self._postings([texts[i] for i in short]).items():
                parts[g].append(np.array(short)[found])
        return {g: np.sort(np.concatenate(x)) if x else np.zeros(0, dtype=np.int64) for g, x in parts.items()}

    def _postings(self, texts: list[bytes]) -> dict[bytes, np.ndarray]:
        raw = self.fold[np.frombuffer(b"\n".join(texts) + b"\n\n\n", dtype=np.uint8)]
        codes = raw[:-2] << np.uint32(16) | raw[1:-1] << np.uint32(8) | raw[2:]
        at = np.flatnonzero(self.asked[codes])
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        owner, gram = np.searchsorted(ends, at, side="right"), np.searchsorted(self.codes, codes[at])
        both = np.unique(gram * len(texts) + owner)
        gram, owner = both // len(texts), both % len(texts)
        bounds = np.searchsorted(gram, np.arange(len(self.grams) + 1))
        return {g: owner[bounds[i] : bounds[i + 1]] for i, g in enumerate(self.grams)}

    def scan(self, texts: list[bytes]) -> list[list[tuple[int, str, int, int]]]:
        """(start, place of the rule, kind, end) of each text's spans, in order."""
        found: list[list] = [[] for _ in texts]
        postings = self.postings(texts)
        decoded: dict[int, str] = {}
        for place, rule, compiled, query in self.rules:
            for i in range(len(texts)) if query is True else _candidates(query, postings).tolist():
                if i not in decoded:
                    decoded[i] = texts[i].decode()
                for m in compiled.finditer(decoded[i]):
                    if m.end(rule.group) - m.start(rule.group) >= rule.min_length:
                        found[i].append((m.start(), place, rule.kind, m.end()))
        for x in found:
            x.sort()
        return found


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", *, rules: tuple[Rule, ...] = BASE + EXTRA) -> DataFrame:
    """doc_id and spans (kind, start, end; in code points, end exclusive; by start, then by the rules' order) of each row.

    Matches of a rule are its leftmost non-overlapping ones. Null text counts as empty, which has no spans; null
    doc_ids stay null; repeated rows are scanned each; an empty table gives an empty result; other columns are not
    looked at. A text is matched whole, however long; its trigrams are looked up piece by piece.
    """
    small_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(rules)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in steps(batches):
            spans = [[{"kind": k, "start": a, "end": b} for a, _, k, b in x] for x in index.scan(as_bytes(batch.column(1)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], names=["doc_id", "spans"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(work, "doc_id long, spans array<struct<kind: string, start: long, end: long>>")


def report(docs: DataFrame, **names: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans as text, for each row; nulls, empty and repeated rows as
    scan says. A text without spans has zeros, the hash of the empty string and no spans."""
    told = lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])
    found = scan(docs, **names)
    base = F.filter("spans", lambda x: x["kind"].isin([r.kind for r in BASE]))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(r.kind) for r in BASE]
    return found.select("doc_id", *counts, F.sha2(F.array_join(F.transform(base, told), ","), 256).alias("base_sha256"), F.array_join(F.transform("spans", told), ",").alias("spans"))
