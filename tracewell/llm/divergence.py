"""How sources of a language differ in their words: sums of differences between smoothed shares for every pair of
sources, and each source's most over-represented terms.

Shares are whole numbers of billionths (ONE). A term that a source never uses has the source's base share, so sums over
all kept terms are the number of terms times the difference of two bases, corrected where a term occurs: nothing is
computed for terms that neither source has. Top terms come from a radix selection: histograms over ten bits of the value
at a time find each group's k-th value, histograms over two bytes of the term at a time cut its ties.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.shared import as_bytes, small_batches
from tracewell.storage import cut, drop_cut

ONE, PRIOR, LEAST_DOCUMENTS, RANKS = 1_000_000_000, 5, 30, 50
#: Bits of a value that one histogram covers, and bits of a value in all (ONE needs 30).
DIGIT, VALUE_BITS = 10, 30
#: Ties that a window may rank at once; more are cut by their bytes first.
FEW = 4096
GROUP = ["lang", "source"]

#: A-Z become a-z, letters and bytes of other characters stay, all others end a term.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_PIECE, _HELD = 1 << 20, 200_000


def _pieces(text: bytes) -> Iterator[bytes]:
    """The folded text in pieces that end between terms."""
    start = 0
    while start < len(text):
        end = text.find(b" ", start + _PIECE)
        end = len(text) if end < 0 else end
        yield text[start:end]
        start = end


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): how often and in how many documents. Null text, lang and source count as empty; every
    group has the term '' with zeros, so that groups without terms are there. Tasks add up first, at most _HELD terms
    at once beside those of one document."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for (of, by), (n, seen) in total.items():
                terms = [b"", *n]
                kind = [pa.array(x * len(terms)) for x in ([of], [by])]
                yield pa.RecordBatch.from_arrays([*kind, pa.array(terms, pa.binary()).cast(pa.string()), pa.array([0, *n.values()], pa.int64()), pa.array([0, *(seen[t] for t in n)], pa.int64())], ["lang", "source", "term", "n", "docs"])
            total.clear()

        held = 0
        for batch in batches:
            for of, by, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2)), strict=True):
                n, seen = total.setdefault((of, by), (Counter(), Counter()))
                before = len(n)
                distinct: set[bytes] = set()
                for piece in _pieces(raw.translate(_FOLD)):
                    terms = piece.split()
                    n.update(terms)
                    distinct.update(terms)
                seen.update(distinct)
                held += len(n) - before
                if held > _HELD:
                    yield from out()
                    held = 0
        yield from out()

    blank = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang, "lang"), (source, "source"), (text, "text"))]
    parts = docs.select(*blank).mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(ONE * (n + PRIOR) / (total + PRIOR * terms)), exact; null without terms."""
    whole = lambda c: c.cast("decimal(20,0)")
    above, below = F.lit(ONE).cast("decimal(10,0)") * (whole(n) + PRIOR), whole(total) + PRIOR * whole(terms)
    return F.when(terms > 0, F.call_function("div", above, below) + 1)


def _shares(counts: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(lang, source, n_terms, base) of every group and (lang, source, item, n, p, q, base) of the kept terms that each
    group has, as tables."""
    vocabulary = cut(counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(F.col("docs") >= least), "divergence-terms")
    of_lang = vocabulary.groupBy("lang").agg(F.count("*").alias("n_terms"), F.sum("lang_n").alias("lang_total"))
    kept = cut(counts.where("n > 0").join(vocabulary.select("lang", "term", "lang_n"), ["lang", "term"]).select("lang", "source", F.col("term").alias("item"), "n", "lang_n"), "divergence-kept")
    groups = counts.select(*GROUP).distinct().join(kept.groupBy(*GROUP).agg(F.sum("n").alias("total")), GROUP, "left").join(of_lang, "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("total", "n_terms", "lang_total")])
    groups = cut(groups.withColumn("base", share(F.lit(0), F.col("total"), F.col("n_terms"))), "divergence-groups")
    p, q = share(F.col("n"), F.col("total"), F.col("n_terms")), share(F.col("lang_n"), F.col("lang_total"), F.col("n_terms"))
    shares = cut(kept.join(groups, GROUP).select("lang", "source", "item", p.alias("p"), q.alias("q"), "base"), "divergence-shares")
    drop_cut(vocabulary, kept)
    return groups, shares


def _pairs(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """(lang, source, item, value) for every two sources of a language, both ways."""
    one, other = groups.select("lang", "source", "n_terms", "base"), groups.select("lang", F.col("source").alias("item"), F.col("base").alias("item_base"))
    both = one.join(other, "lang").where("source <> item")  # as many rows as the result has
    # terms of `source` against the base of `item`: sums of the shares below it, from a running sum over the distinct shares
    steps = shares.groupBy(*GROUP, F.col("p").alias("at")).agg(F.count("*").alias("n"), F.sum("p").alias("s"))
    none = F.lit(0).cast("long")
    line = steps.select(*GROUP, F.lit(None).cast("string").alias("item"), "at", "n", "s").unionByName(both.where("base is not null").select(*GROUP, "item", F.col("item_base").alias("at"), none.alias("n"), none.alias("s")))
    w = Window.partitionBy(*GROUP)
    upto = w.orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    line = line.select(*GROUP, "item", "at", F.sum("n").over(upto).alias("n"), F.sum("s").over(upto).alias("s"), F.sum("n").over(w).alias("all_n"), F.sum("s").over(w).alias("all_s")).where("item is not null")
    far = line.select(*GROUP, "item", (F.col("all_s") - 2 * F.col("s") + F.col("at") * (2 * F.col("n") - F.col("all_n"))).alias("far"), "all_n")
    # terms of both
    a, b = shares.alias("a"), shares.alias("b")
    met = a.join(b, (F.col("a.lang") == F.col("b.lang")) & (F.col("a.item") == F.col("b.item")) & (F.col("a.source") < F.col("b.source")))
    gap = lambda x, y: F.abs(F.col(x) - F.col(y))
    met = met.groupBy(F.col("a.lang").alias("lang"), F.col("a.source").alias("source"), F.col("b.source").alias("item"))
    met = met.agg(F.sum(gap("a.p", "b.p") - gap("a.p", "b.base") - gap("a.base", "b.p") + gap("a.base", "b.base")).alias("met"))
    far, met = cut(far, "divergence-far"), cut(met, "divergence-met")
    turned = lambda df, c: df.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), *c)
    met = met.unionByName(turned(met, ["met"]))
    back = turned(far, [F.col("far").alias("back"), F.col("all_n").alias("back_n")])
    on = [*GROUP, "item"]
    zero = lambda c: F.coalesce(F.col(c), none)
    value = (F.col("n_terms") - zero("all_n") - zero("back_n")) * gap("base", "item_base") + zero("far") + zero("back") + zero("met")
    return both.join(far, on, "left").join(back, on, "left").join(met, on, "left").select(*on, F.coalesce(value, none).alias("value"))


def _crossing(bins: DataFrame, by: list[str], order: Column) -> DataFrame:
    """Of each group's bins (digit, n, need) in order the one in which the need-th row lies, with what is needed of it."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return bins.withColumn("upto", F.sum("n").over(w)).where("upto >= need and upto - n < need").withColumn("need", F.col("need") - F.col("upto") + F.col("n")).drop("upto")


def top(rows: DataFrame, by: list[str], k: int, value: str = "value", item: str = "item", few: int = FEW) -> DataFrame:
    """The k rows of each group with the largest values (0 to 2**30 - 1), of equal ones the smallest items by their UTF-8
    bytes, with rank. Items of a group are distinct. A group reaches a window only after the selection has left it
    k + few rows at most; what a histogram gives is 1,024 rows a group, or 65,536 for two bytes."""
    sizes = rows.groupBy(*by).agg(F.count("*").alias("n"))
    state = cut(sizes.where(F.col("n") > k).select(*by, F.lit(0).cast("long").alias("at"), F.lit(k).cast("long").alias("need"), "n"), "radix-0")
    for shift in range(VALUE_BITS - DIGIT, -1, -DIGIT):
        inside = rows.join(state.drop("n"), by).where(F.shiftright(value, shift + DIGIT) == F.col("at"))
        bins = inside.groupBy(*by, F.shiftright(value, shift).alias("digit"), "need").agg(F.count("*").alias("n"))
        after = cut(_crossing(bins, by, F.desc("digit")).select(*by, F.col("digit").alias("at"), "need", "n"), f"radix-{shift}")
        drop_cut(state)
        state = after
    # `at` is each group's k-th value; of its n rows with that value `need` are wanted, the first by their bytes
    data = F.encode(item, "utf-8")
    done: list[DataFrame] = []
    state = state.withColumn("path", F.lit(b"")).withColumn("depth", F.lit(0))
    while True:
        many = (F.col("n") > few) & (F.col("need") < F.col("n")) & (F.octet_length("path") == F.col("depth"))
        open_ = state.where(many)
        done.append(state.where(~many))
        if open_.head() is None:
            break
        more = F.substring(data, F.col("depth") + 1, F.lit(2))
        inside = rows.join(open_.drop("n"), by).where((F.col(value) == F.col("at")) & (F.substring(data, F.lit(1), F.col("depth")) == F.col("path")))
        bins = inside.groupBy(*by, "at", "need", "path", "depth", more.alias("digit")).agg(F.count("*").alias("n"))
        state = cut(_crossing(bins, by, F.asc("digit")).select(*by, "at", "need", "n", F.concat("path", "digit").alias("path"), (F.col("depth") + 2).alias("depth")), "radix-bytes")
    ends = done[0]
    for d in done[1:]:
        ends = ends.unionByName(d)
    found = rows.join(ends.select(*by, "at", "path", "depth"), by, "left")
    found = found.where(F.col("at").isNull() | (F.col(value) > F.col("at")) | ((F.col(value) == F.col("at")) & (F.substring(data, F.lit(1), F.col("depth")) <= F.col("path"))))
    w = Window.partitionBy(*by).orderBy(F.desc(value), F.asc(item))
    return found.select(*by, item, value, F.row_number().over(w).alias("rank")).where(F.col("rank") <= k)


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", *, least: int = LEAST_DOCUMENTS, k: int = RANKS) -> DataFrame:
    """lang, source, part, item, value, rank: in part `pair` every other source of the language, in part `term` the k terms
    whose share most exceeds that in the language.

    Terms are runs of letters A-Z (folded to a-z) and of characters beyond ASCII; a language keeps those of `least`
    documents (rows) of it. Null and empty texts have no terms, but their groups have pairs, of value 0 where the
    language keeps no term. Null lang and source are empty ones. Repeated rows and ids count each, other columns are
    left alone, an empty table gives no rows. Values rank falling, equal ones by the item's UTF-8 bytes."""
    counts = cut(term_counts(docs, text, lang, source), "divergence-counts")
    groups, shares = _shares(counts, least)
    drop_cut(counts)
    w = Window.partitionBy(*GROUP).orderBy(F.desc("value"), F.asc("item"))  # a row for each other source
    pairs = _pairs(groups, shares).withColumn("rank", F.row_number().over(w))
    over = cut(shares.where("p > q").select(*GROUP, "item", (F.col("p") - F.col("q")).alias("value")), "divergence-over")
    terms = top(over, GROUP, k)
    named = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))
    return named(pairs, "pair").unionByName(named(terms, "term"))
