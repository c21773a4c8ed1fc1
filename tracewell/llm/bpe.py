"""Byte-level BPE by DuckDB recursive queries that run inside each partition.

The merge table lists, for each vocabulary entry, every split of its bytes into two entries; the entry's rank
is the pair's. Token-position rows of a partition's new distinct words join it; each step of the recursive
query contracts every word's leftmost pair of least rank, until no pair is left. Ordered aggregations over the
positions give a word's ids and, through the vocabulary, its decoded bytes. Words repeat, so a task keeps what the
queries returned, bounded by bytes; it goes with the task.

A long word is cut into chunks that are contracted as words of their own. Two neighbouring tokens of an encoding
are valid beside each other: contracted together they come out as the same two, because nothing outside them acts
on them before something crosses their borders. A sequence whose neighbours are all valid is the encoding of its
bytes, for the same reason. So a window over a chunk's last and the next one's first tokens decides: if its own
encoding begins and ends with the same tokens, it stands between the two chunks; if not, the chunks are joined
and contracted again, by a query that takes all pairs of one rank in a step where none of them brings a lower one.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
from collections.abc import Iterable, Iterator

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.shared import small_batches, steps

#: Bytes of words that one recursive query takes; bytes that a task remembers of words and their codes.
QUERY_BYTES, CACHE_BYTES = 150_000, 16 << 20
#: Bytes of text that are split and put together at once; a longer text goes through word by word.
STEP = 2 << 20
#: A longer word is cut into chunks of CHUNK bytes, within segments of SEGMENT bytes; tokens on either side in a window.
CHUNK, SEGMENT, BESIDE = 64, 1 << 18, 4
#: Rows that one query over joined chunks may leave behind; it goes on from there in another one.
STATE_ROWS = 2_000_000
MEMORY = "200MB"

#: `best`: rank and position of the pair that begins at the row, null if it is none.
STATES = """
WITH RECURSIVE state(word, pos, tok, nxt, width, best, step) AS (
  SELECT word, pos, tok, nxt, 1, m.rank::BIGINT << 32 | pos, 0 FROM tokens LEFT JOIN merges m ON m.pair = (tok::BIGINT * 4294967296 + nxt)
  UNION ALL (
    WITH least AS (
      SELECT word, min(best) AS best, arg_min(pos + width, best) AS gone FROM state WHERE best IS NOT NULL GROUP BY word
    ), chosen AS (
      SELECT l.word, (l.best & 4294967295)::INTEGER AS pos, (l.best >> 32)::INTEGER AS rank, l.gone, s.nxt, s.width
      FROM least l JOIN state s ON s.word = l.word AND s.pos = l.gone
    ), moved AS (
      SELECT s.word, s.pos, CASE WHEN s.pos = c.pos THEN c.rank ELSE s.tok END AS tok,
             CASE WHEN s.pos = c.pos THEN c.nxt WHEN s.pos + s.width = c.pos THEN c.rank ELSE s.nxt END AS nxt,
             CASE WHEN s.pos = c.pos THEN s.width + c.width ELSE s.width END AS width, s.best, s.step + 1 AS step,
             s.pos = c.pos OR s.pos + s.width = c.pos AS changed
      FROM state s JOIN chosen c ON s.word = c.word WHERE s.pos <> c.gone
    )
    SELECT word, pos, tok, nxt, width, best, step FROM moved WHERE NOT changed
    UNION ALL
    SELECT word, pos, tok, nxt, width, m.rank::BIGINT << 32 | pos, step FROM moved LEFT JOIN merges m ON m.pair = (tok::BIGINT * 4294967296 + nxt) WHERE changed
  )
), settled AS (
  SELECT s.* FROM state s JOIN (SELECT word, max(step) AS step FROM state GROUP BY word) last ON last.word = s.word AND last.step = s.step
)
"""
#: A step takes a word's pairs of least rank from the left, each second one where they overlap, up to the first that
#: brings a pair of lower rank: what the leftmost pair alone would do, one step after another.
LEVELS = """
WITH RECURSIVE state(word, pos, prv, tok, nxt, stop, rank, step) AS (
  SELECT word, pos, prv, tok, nxt, stop, rank, 0 FROM reached
  UNION ALL (
    WITH least AS (SELECT word, min(rank) AS r FROM state WHERE step < $steps AND rank IS NOT NULL GROUP BY word),
    met AS (
      SELECT s.word, s.pos, s.prv, s.stop AS gone, l.r, coalesce(lag(s.stop) OVER (PARTITION BY s.word ORDER BY s.pos) = s.pos, false) AS tied
      FROM state s JOIN least l ON s.word = l.word AND s.rank = l.r
    ), chains AS (SELECT *, sum((NOT tied)::INTEGER) OVER (PARTITION BY word ORDER BY pos) AS chain FROM met),
    turns AS (SELECT *, row_number() OVER (PARTITION BY word, chain ORDER BY pos) AS nth FROM chains),
    pairs AS (
      SELECT t.word, t.pos, t.prv, t.gone, t.r, g.nxt, g.stop FROM turns t JOIN state g ON g.word = t.word AND g.pos = t.gone WHERE nth % 2 = 1
    ), beside AS (
      SELECT *, CASE WHEN lag(stop) OVER (PARTITION BY word ORDER BY pos) = pos THEN r ELSE prv END AS before FROM pairs
    ), lower AS (
      SELECT b.word, min(b.pos) AS pos FROM beside b
      LEFT JOIN merges x ON x.pair = (b.before::BIGINT * 4294967296 + b.r) LEFT JOIN merges y ON y.pair = (b.r::BIGINT * 4294967296 + b.nxt)
      WHERE x.rank < b.r OR y.rank < b.r GROUP BY b.word
    ), chosen AS (
      SELECT b.word, b.pos, b.gone, b.r, b.nxt, b.stop FROM beside b LEFT JOIN lower o ON o.word = b.word WHERE o.pos IS NULL OR b.pos <= o.pos
    ), kept AS (
      SELECT s.word, s.pos, s.prv, coalesce(c.r, s.tok) AS tok, coalesce(c.nxt, s.nxt) AS nxt, coalesce(c.stop, s.stop) AS stop, s.rank, s.step + 1 AS step, c.r IS NOT NULL AS changed
      FROM state s JOIN least l ON l.word = s.word LEFT JOIN chosen c ON c.word = s.word AND c.pos = s.pos
      LEFT JOIN chosen d ON d.word = s.word AND d.gone = s.pos WHERE d.word IS NULL
    ), moved AS (
      SELECT k.word, k.pos, coalesce(p.r, k.prv) AS prv, k.tok, coalesce(n.r, k.nxt) AS nxt, k.stop, k.rank, k.step, k.changed OR n.r IS NOT NULL AS changed
      FROM kept k LEFT JOIN chosen n ON n.word = k.word AND n.pos = k.stop LEFT JOIN chosen p ON p.word = k.word AND p.stop = k.pos
    )
    SELECT word, pos, prv, tok, nxt, stop, rank, step FROM moved WHERE NOT changed
    UNION ALL
    SELECT word, pos, prv, tok, nxt, stop, m.rank, step FROM moved LEFT JOIN merges m ON m.pair = (tok::BIGINT * 4294967296 + nxt) WHERE changed
  )
), settled AS (
  SELECT s.* FROM state s JOIN (SELECT word, max(step) AS step FROM state GROUP BY word) last ON last.word = s.word AND last.step = s.step
)
"""
DECODE = """
SELECT string_agg(tok::VARCHAR, ' ' ORDER BY pos) AS ids, unhex(string_agg(piece, '' ORDER BY pos)) AS bytes, count(*) AS n
FROM settled JOIN vocabulary USING (tok) GROUP BY word ORDER BY word
"""
IDS = "SELECT list(tok ORDER BY pos) AS ids FROM settled GROUP BY word ORDER BY word"
#: What stands behind a space, of letters that no version of Unicode doubts and signs: one or two words.
PLAIN = r"\A(?P<letters>[A-Za-zÀ-ÖØ-öø-ÿ]*)(?P<signs>[!-&(-/:-@\[-`{-~]*)\z"

#: Ids joined by one space, decoded bytes and number of ids, of words or of texts.
Coded = tuple[pa.Array, pa.Array, pa.Array]


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    """The ranks of a .tiktoken file: base64 of a token's bytes and its rank on each line."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}


def tables(ranks: dict[bytes, int]) -> tuple[pa.Table, pa.Table]:
    """The merge table (pair: two ids in one number; rank) and the vocabulary (tok, raw, piece: its bytes as digits)."""
    pair, rank = [], []
    for entry, number in ranks.items():
        for i in range(1, len(entry)):
            a = ranks.get(entry[:i])
            if a is not None and (b := ranks.get(entry[i:])) is not None:
                pair.append(a << 32 | b)
                rank.append(number)
    merges = pa.table({"pair": pa.array(pair, pa.int64()), "rank": pa.array(rank, pa.int32())})
    return merges, pa.table({"tok": pa.array(list(ranks.values()), pa.int32()), "raw": pa.array(list(ranks), pa.binary()), "piece": [b.hex() for b in ranks]})


class Codec:
    """Encodes and decodes the words of one task."""

    def __init__(self, merges: pa.Table, vocabulary: pa.Table, pattern: str):
        self.split = regex.compile(pattern)
        self.spaces = pattern == public_tokenizers.PATTERN
        self.raw, self.tok = vocabulary["raw"].combine_chunks(), vocabulary["tok"].to_numpy()
        self.piece = dict(zip(self.tok.tolist(), self.raw.to_pylist(), strict=True))
        by = {b: t for t, b in self.piece.items() if len(b) == 1}
        self.byte = np.array([by[bytes([i])] for i in range(256)], dtype=np.int32)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})
        self._table("merges", merges)
        self._table("vocabulary", vocabulary.select(["tok", "piece"]))
        self.known = pa.array([], pa.binary())
        self.codes: Coded = self._none()

    def close(self) -> None:
        self.db.close()

    @staticmethod
    def _none() -> Coded:
        return pa.array([], pa.string()), pa.array([], pa.binary()), pa.array([], pa.int64())

    def _table(self, name: str, rows: pa.Table) -> None:
        self.db.register("new", rows)
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM new")
        self.db.unregister("new")

    def _rows(self, words: pa.Array) -> tuple[pa.Array, dict[str, np.ndarray]]:
        """Token-position rows of words, a byte each; nxt is -1 at a word's end."""
        offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
        n = np.diff(offsets)
        tok = self.byte[np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]]
        nxt, ends = np.append(tok[1:], np.int32(-1)), np.cumsum(n)
        nxt[ends - 1] = -1
        return {"word": np.repeat(np.arange(len(n), dtype=np.int32), n), "pos": (np.arange(len(tok)) - np.repeat(ends - n, n)).astype(np.int32), "tok": tok, "nxt": nxt}

    def _groups(self, words: pa.Array) -> Iterator[np.ndarray]:
        """Places of words whose bytes fill one query; words of about one length come together."""
        n = pc.binary_length(words).to_numpy()
        order = np.argsort(n, kind="stable")
        yield from np.split(order, np.flatnonzero(np.diff(np.cumsum(n[order]) // QUERY_BYTES)) + 1)

    def _query(self, words: pa.Array, what: str) -> pa.Table:
        """Words of CHUNK bytes at most, one step of the recursive query for each contraction."""
        self._table("tokens", pa.table(self._rows(words)))
        return self.db.sql(STATES + what).to_arrow_table()

    def encode(self, words: pa.Array) -> Coded:
        """Codes of distinct words, in their order."""
        at = pc.index_in(words, value_set=self.known)
        fresh = words.filter(pc.is_null(at))
        if len(fresh):
            codes = self._learn(fresh)
            if self.known.nbytes + sum(c.nbytes for c in self.codes) + fresh.nbytes + sum(c.nbytes for c in codes) > CACHE_BYTES:
                kept = pc.drop_null(at).unique()  # what this step needs of the old ones
                self.known, self.codes = self.known.take(kept), tuple(c.take(kept) for c in self.codes)
            self.known = pa.concat_arrays([self.known, fresh])
            self.codes = tuple(pa.concat_arrays(x) for x in zip(self.codes, codes, strict=True))
            at = pc.index_in(words, value_set=self.known)
        return tuple(c.take(at) for c in self.codes)

    def _learn(self, words: pa.Array) -> Coded:
        whole = pc.index_in(words, value_set=self.raw)  # a word that is an entry is that entry
        long = pc.greater(pc.binary_length(words), CHUNK).to_numpy(zero_copy_only=False) & np.asarray(pc.is_null(whole))
        entry = np.asarray(pc.is_valid(whole))
        places, found = [np.flatnonzero(entry)], [(pa.array(self.tok[np.asarray(pc.drop_null(whole))]).cast(pa.string()), self.raw.take(pc.drop_null(whole)), pa.array(np.ones(int(entry.sum()), np.int64)))]
        short = np.flatnonzero(~entry & ~long)
        for group in self._groups(words.take(pa.array(short))) if len(short) else ():
            places.append(short[group])
            made = self._query(words.take(pa.array(places[-1])), DECODE)
            found.append(tuple(made[c].combine_chunks() for c in ("ids", "bytes", "n")))
        for i in np.flatnonzero(long):
            ids = self.encode_long(words[i].as_py())
            places.append(np.array([i]))
            found.append((pa.array([" ".join(map(str, ids.tolist()))]), pa.array([self.decode(ids)], pa.binary()), pa.array([len(ids)], pa.int64())))
        order = pa.array(np.argsort(np.concatenate(places)))
        return tuple(pa.concat_arrays(x).take(order) for x in zip(*found, strict=True))

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of ids in their order."""
        out = []
        for a in range(0, len(ids), QUERY_BYTES):
            part = ids[a : a + QUERY_BYTES]
            self._table("settled", pa.table({"word": np.zeros(len(part), np.int32), "pos": np.arange(len(part), dtype=np.int32), "tok": part.astype(np.int32)}))
            out.append(self.db.sql(DECODE).to_arrow_table()["bytes"][0].as_py())
        return b"".join(out)

    def encode_long(self, word: bytes) -> np.ndarray:
        """Ids of a word of any length, segment by segment; the last tokens are looked at again with what follows."""
        out = [np.zeros(0, np.int32)]
        for start in range(0, len(word), SEGMENT):
            beside = 2 * BESIDE
            while True:
                while len(out) > 1 and len(out[-1]) < beside:
                    out[-2:] = [np.concatenate(out[-2:])]
                tail = out[-1][-beside:]
                ids = self._segment(self._bytes(tail) + word[start : start + SEGMENT])
                if len(tail) < beside or ids[0] == tail[0]:
                    break
                beside *= 4
            out[-1] = out[-1][: len(out[-1]) - len(tail)]
            out.append(ids)
        return np.concatenate(out)

    def _bytes(self, ids: np.ndarray) -> bytes:
        return b"".join([self.piece[i] for i in ids.tolist()])

    def _segment(self, text: bytes) -> np.ndarray:
        chunks = [text[i : i + CHUNK] for i in range(0, len(text), CHUNK)]
        coded = self._contract(chunks)
        between: list[np.ndarray | None] = [None] * (len(chunks) - 1)  # the window over each border, once it holds
        side = lambda c: min(BESIDE, (len(coded[c]) + 1) // 2)
        while todo := [i for i, x in enumerate(between) if x is None]:
            pairs = [(coded[i][-side(i) :], coded[i + 1][: side(i + 1)]) for i in todo]
            made = self._contract([self._bytes(np.concatenate(p)) for p in pairs])
            for i, (a, b), ids in zip(todo, pairs, made, strict=True):
                if ids[0] == a[0] and ids[-1] == b[-1]:
                    between[i] = ids
            if all(x is not None for x in between):
                break
            # chunks without a border that holds become one; windows beside it are looked at again
            first, i = [], 0
            while i < len(chunks):
                first.append(i)
                end = i + 1
                while end < len(chunks) and between[end - 1] is None:
                    end += 1
                if end > i + 1 and (size := max(map(len, chunks[i:end]))) > CHUNK:  # joined before: take in as much again
                    while end < len(chunks) and (size > 0 or between[end - 1] is None):
                        size -= len(chunks[end])
                        end += 1
                i = end
            ends = [*first[1:], len(chunks)]
            grown = [e - f > 1 for f, e in zip(first, ends, strict=True)]
            joined = iter(self._contract([b"".join(chunks[f:e]) for f, e, g in zip(first, ends, grown, strict=True) if g]))
            coded = [next(joined) if g else coded[f] for f, g in zip(first, grown, strict=True)]
            chunks = [b"".join(chunks[f:e]) for f, e in zip(first, ends, strict=True)]
            between = [None if grown[k] or grown[k + 1] else between[f - 1] for k, f in enumerate(first[1:])]
        out, skip = [], 0  # skip: tokens of the chunk that the window before it gave
        for i, ids in enumerate(coded):
            end = len(ids) - side(i) if i < len(between) else len(ids)
            out.append(ids[skip:end])
            if i < len(between):
                out.append(between[i][max(0, skip - end) :])
                skip = side(i + 1)
        return np.concatenate(out)

    def _contract(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of words; equal ones are contracted once."""
        coded = pa.array(words, pa.binary()).dictionary_encode()
        unique = coded.dictionary
        long = pc.greater(pc.binary_length(unique), 2 * CHUNK).to_numpy(zero_copy_only=False)
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(unique)
        short = np.flatnonzero(~long)
        for group in self._groups(unique.take(pa.array(short))) if len(short) else ():
            for i, ids in zip(short[group], self._query(unique.take(pa.array(short[group])), IDS)["ids"], strict=True):
                out[i] = ids.values.to_numpy()
        if long.any():
            for i, ids in zip(np.flatnonzero(long), self._by_levels(unique.filter(pa.array(long))), strict=True):
                out[i] = ids.values.to_numpy()
        return [out[i] for i in coded.indices.to_pylist()]

    def _by_levels(self, words: pa.Array) -> pa.ChunkedArray:
        self._table("tokens", pa.table(self._rows(words)))
        self.db.execute("CREATE OR REPLACE TABLE reached AS SELECT word, pos, coalesce(lag(tok) OVER (PARTITION BY word ORDER BY pos), -1) AS prv, tok, nxt, pos + 1 AS stop, m.rank FROM tokens LEFT JOIN merges m ON m.pair = (tok::BIGINT * 4294967296 + nxt)")
        self.db.execute("CREATE OR REPLACE TABLE done (word INTEGER, pos INTEGER, tok INTEGER)")
        while rows := self.db.execute("SELECT count(*) FROM reached").fetchall()[0][0]:
            limit = max(16, STATE_ROWS // rows)
            self.db.execute(f"CREATE OR REPLACE TABLE reached AS {LEVELS.replace('$steps', str(limit))} SELECT word, pos, prv, tok, nxt, stop, rank, count(rank) OVER (PARTITION BY word) AS more FROM settled")
            self.db.execute("INSERT INTO done SELECT word, pos, tok FROM reached WHERE more = 0")
            self.db.execute("CREATE OR REPLACE TABLE reached AS SELECT word, pos, prv, tok, nxt, stop, rank FROM reached WHERE more > 0")
        return self.db.sql(IDS.replace("settled", "done")).to_arrow_table()["ids"]

    def run(self, texts: pa.Array) -> Coded:
        """Codes of each text."""
        units, at, offsets = self._by_spaces(texts) if self.spaces else self._whole(texts)
        counts = np.diff(units.offsets.to_numpy())
        words = units.values.dictionary_encode()
        each = counts[at]
        ends = np.cumsum(each)
        within = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - each, each)
        place = pa.array(words.indices.to_numpy()[np.repeat(units.offsets.to_numpy()[:-1][at], each) + within])
        bounds = np.concatenate(([0], ends))[offsets]
        ids, data, n = self.encode(words.dictionary.cast(pa.binary()))
        lists = lambda x: pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), x.take(place))
        sums = np.concatenate(([0], np.cumsum(n.to_numpy()[place.to_numpy()])))
        return pc.binary_join(lists(ids), " "), pc.binary_join(lists(data), pa.scalar(b"", pa.binary())), pa.array(np.diff(sums[bounds]), pa.int64())

    def _whole(self, texts: pa.Array) -> tuple[pa.ListArray, np.ndarray, np.ndarray]:
        return pa.array([[m[0] for m in self.split.finditer(t)] for t in texts.to_pylist()], pa.list_(pa.string())), np.arange(len(texts)), np.arange(len(texts) + 1)

    def _by_spaces(self, texts: pa.Array) -> tuple[pa.ListArray, np.ndarray, np.ndarray]:
        """Units (lists of words), the units of all texts in order, and where each text's begin.

        What stands between two spaces can be split by itself if it neither starts nor ends with white space: no
        match of the public pattern then reaches over the space before it or behind it. Other texts are split whole."""
        lists = pc.split_pattern(texts, " ")
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        coded = lists.flatten().dictionary_encode()
        at, pieces = coded.indices.to_numpy().copy(), coded.dictionary
        plain = pc.extract_regex(pieces, pattern=PLAIN)
        letters, signs = plain.field("letters"), plain.field("signs")
        easy = np.asarray(pc.and_(pc.fill_null(plain.is_valid(), False), pc.greater(pc.utf8_length(pieces), 0)))
        odd = np.flatnonzero(~easy)
        made, bound = [], np.zeros(len(pieces), dtype=bool)
        for i, p in zip(odd.tolist(), pieces.take(pa.array(odd)).to_pylist(), strict=True):
            bound[i] = not p or p[0].isspace() or p[-1].isspace()
            made.append([] if bound[i] else self.split.findall(" " + p))
        heads = at[offsets[:-1]]
        whole = np.logical_or.reduceat(bound[at], offsets[:-1]) if len(at) else np.zeros(0, dtype=bool)
        heads = pieces.take(pa.array(heads)).to_pylist()
        chosen = texts.take(pa.array(np.flatnonzero(whole))).to_pylist()
        texts_left = iter(chosen)
        made += [self.split.findall(next(texts_left) if w else h) for w, h in zip(whole.tolist(), heads, strict=True)]
        # units: easy pieces, then odd ones, then heads
        letters, signs = letters.filter(pa.array(easy)), signs.filter(pa.array(easy))
        has = np.stack([np.asarray(pc.not_equal(x, "")) for x in (letters, signs)], axis=1)
        space = pa.scalar(" ")
        first = pc.binary_join_element_wise(space, pc.if_else(pa.array(has[:, 0]), letters, signs), "")
        second = signs.filter(pa.array(has.all(axis=1)))
        n = has.sum(axis=1)
        starts = np.cumsum(n) - n
        order = np.empty(int(n.sum()), dtype=np.int64)
        order[starts] = np.arange(len(n))
        order[starts[n == 2] + 1] = len(n) + np.arange(len(second))
        values = pa.concat_arrays([pa.concat_arrays([first, second]).take(pa.array(order)), pa.array(list(itertools.chain.from_iterable(made)), pa.string())])
        sizes = np.concatenate((n, np.fromiter(map(len, made), np.int64, len(made))))
        units = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), values)
        unit = np.empty(len(pieces), dtype=np.int64)
        unit[easy] = np.arange(len(n))
        unit[odd] = len(n) + np.arange(len(odd))
        at = unit[at]
        at[offsets[:-1]] = len(n) + len(odd) + np.arange(len(texts))
        keep = ~np.repeat(whole, np.diff(offsets))
        keep[offsets[:-1]] = True
        return units, at[keep], np.concatenate(([0], np.cumsum(keep)))[offsets]

    def stream(self, text: str) -> Iterator[Coded]:
        """Codes of a long text's words, some at a time."""
        def parts() -> Iterator[list[str]]:
            part, size = [], 0
            for m in self.split.finditer(text):
                part.append(m[0])
                size += len(m[0])
                if size > STEP // 8 or len(part) >= 1 << 16:
                    yield part
                    part, size = [], 0
            if part:
                yield part

        for part in parts():
            words = pa.array(part, pa.string()).dictionary_encode()
            yield tuple(c.take(words.indices) for c in self.encode(words.dictionary.cast(pa.binary())))


def _joined(parts: Iterable[Coded], outputs: bool) -> tuple[int, str, str, list[int], bytes]:
    """n_tokens, both digests and, with outputs, ids and bytes of a text whose codes come in parts."""
    n, ids_sha, data_sha, ids, data = 0, hashlib.sha256(), hashlib.sha256(), [], []
    for a, b, c in parts:
        text = (" " if n else "") + " ".join(a.to_pylist())
        ids_sha.update(text.encode())
        raw = b"".join(b.to_pylist())
        data_sha.update(raw)
        n += pc.sum(c).as_py()
        if outputs:
            ids += map(int, text.split())
            data.append(raw)
    return n, ids_sha.hexdigest(), data_sha.hexdigest(), ids, b"".join(data)


def encode_decode(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", *, ranks_path: str | None = None, pattern: str | None = None, outputs: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256; with `outputs` also ids and decoded.

    ids are those of the ranks at ranks_path (public byte_bpe_50k by default), each match of the pattern
    encoded separately, without special tokens; ids_sha256 is of the decimal ids joined by one space,
    decoded_sha256 of the bytes the ids decode to. Null text counts as empty: no tokens, hashes of the empty
    string. Null doc_ids stay null, rows may repeat, an empty table gives an empty result; other columns are not
    looked at. A text is one row of one task's work; of a long one, and of a long word, the codes come in parts,
    so that with digests alone memory holds the text itself and little more.
    """
    small_batches(docs.sparkSession)
    with open(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        sent = docs.sparkSession.sparkContext.broadcast(tables(parse_ranks(file.read())))  # made of one file of fixed size
    pattern = pattern or public_tokenizers.PATTERN
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * outputs
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids", "decoded"] * outputs]

    def coded(coder: Codec, batch: pa.RecordBatch) -> list[pa.Array]:
        texts = pc.fill_null(batch.column(1), "")
        if len(texts) == 1 and texts.nbytes > STEP:
            n, *sha, numbers, raw = _joined(coder.stream(texts[0].as_py()), outputs)
            return [pa.array([n], pa.int64()), *(pa.array([x]) for x in sha), *([pa.array([numbers], pa.list_(pa.int32())), pa.array([raw]).cast(pa.string())] if outputs else [])]
        ids, data, n = coder.run(texts)
        sha = [pa.array([hashlib.sha256(x).hexdigest() for x in column.to_pylist()], pa.string()) for column in (ids.cast(pa.binary()), data)]
        return [n, *sha, *([pa.array([list(map(int, a.split())) for a in ids.to_pylist()], pa.list_(pa.int32())), data.cast(pa.string())] if outputs else [])]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        try:
            for batch in steps(batches, limit=STEP):
                coder = coder or Codec(*sent.value, pattern)
                yield pa.RecordBatch.from_arrays([batch.column(0), *coded(coder, batch)], names=names)
        finally:
            if coder:
                coder.close()
                coder = None
                pa.default_memory_pool().release_unused()

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(work, schema)
