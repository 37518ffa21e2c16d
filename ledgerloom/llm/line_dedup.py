"""Line dedup by an exact set-similarity join, with DataFrame functions only.

A line's tokens are its distinct shingles of SHINGLE words (the whole line if it has fewer words). A line
goes if an earlier line, by document id and then place, has a token set of Jaccard similarity PERCENT / 100
or more. Lines with equal sets are one class from the start; its first line stands for it.

Tokens are ordered by hash, but frequent ones come last. Two similar lines share a token in their prefixes, the first
n - ceil(n * PERCENT / 100) + 1 tokens. All texts are hashed once: prefixes are first taken by hash alone, one per class.
Their tokens are counted in CELLS hash cells, and those of the cells that stand out, at most FREQUENT, once more in
cells of other bits (tables of fixed size). Tokens that stand out in both are the frequent ones, the most frequent last; all
others are rare alike. Lines with a frequent token often share more that come late by hash, so all tokens of these lines
are hashed and counted again, which decides. A prefix without a frequent token is the same in either order; only lines
with one get a new prefix.

Prefix tokens travel once, and only those that recur go on. The length filter and the positional filter
(tokens still to come on the shorter side) thin the candidates, and the sets decide. First each line
meets the earliest line of its tokens, which settles groups of copies with one comparison per line; lines
still without a match meet all others that share a token and lie in a near band of lengths. These carry bit
maps of their sets: bits that one side alone has count tokens that can't be shared, which leaves out pairs before
sets are fetched and never a similar one. Each line is compared with its likeliest partner first, and only if they
aren't similar with all.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.session import cut, saved

SHINGLE = 5
PERCENT = 75
CELL_BITS = 16
CELLS = 1 << CELL_BITS
#: What stands between words besides the space; line feeds cut lines before.
OTHER_SPACES = "\t\x0b\x0c\r"
#: A cell with this many times the usual share of the corpus is dealt over several tasks.
HOT_SHARE = 16
#: Cells of each table that may be taken for frequent.
FREQUENT = CELLS // 32
#: A cell stands out by so many square roots of the usual count.
STANDS_OUT = 5
#: Ids of candidate lines, and pairs, are broadcast up to this many rows, else joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def _has_word(line: Column) -> Column:
    return F.ltrim(line, F.lit(" " + OTHER_SPACES)) != ""


def _lines(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, line_no, line) of lines with a word."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where(_has_word(F.col("line")))


def _words(line: Column) -> Column:
    """Words of a line: cut at single spaces (no regular expression), other white space made spaces where there is any."""
    others = reduce(Column.__or__, [F.contains(line, F.lit(c)) for c in OTHER_SPACES])
    return F.array_remove(F.split(F.when(others, F.regexp_replace(line, f"[{OTHER_SPACES}]", " ")).otherwise(line), " "), "")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is bound to a variable, so that it isn't written to a row and read for each token."""
    return F.get(F.transform(F.array(value), body), 0)


def _tokens(line: Column) -> Column:
    """All tokens of a line: hashes of SHINGLE words, or of all if there are fewer (nulls behind the last leave a hash as it is).

    A token is the hash of two overlapping runs of words, each hashed once: fewer lookups than a word at a time.
    """
    reach = SHINGLE // 2
    count = lambda a: F.greatest(F.size(a) - (SHINGLE - 1), F.lit(1))
    runs = lambda w: F.transform(w, lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, SHINGLE - reach)]))
    paired = lambda r: F.zip_with(F.slice(r, F.lit(1), count(r)), F.slice(r, F.lit(reach + 1), count(r)), lambda a, b: F.xxhash64(a, b))
    return _let(_words(line), lambda w: _let(runs(w), paired))


def _cell(h: Column, table: int = 0) -> Column:
    """Cell of a hash in either table; of its low bits, as the high ones are alike in prefixes by hash."""
    return F.shiftrightunsigned(h, table * CELL_BITS).bitwiseAND(CELLS - 1).cast("int")


def _cells(tokens: DataFrame, table: int = 0) -> np.ndarray:
    """Tokens (h) in each hash cell."""
    counts = np.zeros(CELLS, np.int64)
    for r in tokens.groupBy(_cell(F.col("h"), table).alias("cell")).agg(F.count("*").alias("n")).collect():  # at most CELLS rows
        counts[r["cell"]] = r["n"]
    return counts


def _listed(values: np.ndarray, kind: str) -> Column:
    """An array literal, handed over as one string that the optimizer folds."""
    return F.split(F.lit(",".join(map(str, values.tolist()))), ",").cast(f"array<{kind}>")


def _ranks(counts: np.ndarray, least: float) -> np.ndarray:
    """1 and up for cells of over least tokens, the fullest last, and 0 for all others."""
    last = np.argsort(counts, kind="stable")[-FREQUENT:]
    last = last[counts[last] > least]
    ranks = np.zeros(CELLS, np.int16)
    ranks[last] = np.arange(1, len(last) + 1)
    return ranks


def _frequent(tokens: DataFrame, counts: np.ndarray, excess: float) -> Callable[[Column], Column] | None:
    """What gives a token's rank among the frequent ones and 0 for all others; none if no token is frequent."""
    fuller = _ranks(counts, counts.sum() / CELLS + excess)
    likely = lambda h: F.get(_listed(fuller, "smallint"), _cell(h)) > 0
    again = _cells(tokens.where(likely(F.col("h"))), 1) if fuller.any() else np.zeros(CELLS, np.int64)
    ranks = _ranks(again, again.sum() / CELLS + excess)
    return (lambda h: F.when(likely(h), F.get(_listed(ranks, "smallint"), _cell(h, 1))).otherwise(F.lit(0).cast("smallint"))) if ranks.any() else None


def _shares(counts: np.ndarray) -> np.ndarray:
    """Tasks that the tokens of each cell are dealt over: one but for hot cells."""
    usual = max(1.0, counts.sum() / CELLS) * HOT_SHARE
    return np.maximum(1, np.ceil(counts / usual)).astype(np.int32)


def _prefix(keys: Column) -> Column:
    return F.slice(keys, 1, (F.size(keys) - F.ceil(F.size(keys) * PERCENT / 100) + 1).cast("int"))


def _lines_at(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, line_no, line) of the lines in ids(doc_id, line_no)."""
    wanted = saved(ids.groupBy("doc_id").agg(F.collect_set("line_no").alias("nos")))
    listed = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    texts = docs.join(listed, "doc_id").select("doc_id", "nos", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return texts.where(F.array_contains("nos", F.col("line_no"))).select("doc_id", "line_no", "line")


def _frequent_last(first: DataFrame, docs: DataFrame, tokens: DataFrame, counts: np.ndarray) -> DataFrame:
    """first(doc_id, line_no, n, prefix) with prefixes in which frequent tokens come last; tokens(h) of its prefixes and their cells' counts."""
    excess = STANDS_OUT * math.sqrt(max(1.0, counts.sum() / CELLS))
    seen = _frequent(tokens, counts, excess)
    if seen is None:
        return first
    has = lambda rank: (F.col("n") > 1) & F.exists("prefix", lambda h: rank(h) > 0)  # noqa: E731  a single token is the prefix in any order
    sets_of = lambda lines: saved(_lines_at(docs, lines.select("doc_id", "line_no")).select("doc_id", "line_no", F.array_distinct(_tokens(F.col("line"))).alias("keys")))
    sets = sets_of(first.where(has(seen)))
    every = sets.select(F.explode("keys").alias("h"))
    rank = _frequent(every, _cells(every), excess)
    if rank is None:
        return first
    sets = sets.union(sets_of(first.where(~has(seen) & has(rank))))
    ordered = F.sort_array(F.transform("keys", lambda h: F.struct(rank(h).alias("rank"), h.alias("h"))))
    again = sets.select("doc_id", "line_no", ordered.alias("keys")).select("doc_id", "line_no", F.size("keys").alias("n"), F.transform(_prefix(F.col("keys")), lambda x: x["h"]).alias("prefix"))
    return first.where(~has(seen) & ~has(rank)).union(saved(again))  # saved, as filters on prefixes would make them twice


def _needed(n: Column, m: Column) -> Column:
    """Shared tokens that sets of n and m need."""
    return F.ceil((n + m) * PERCENT / (100 + PERCENT))


def _may_match(n: Column, i: Column, m: Column, j: Column) -> Column:
    """Length filter and positional filter: this token and those after it on either side must do."""
    return (100 * n >= PERCENT * m) & (100 * m >= PERCENT * n) & (1 + F.least(n - i, m - j) >= _needed(n, m))


def _with_bits(sets: DataFrame) -> DataFrame:
    """sets with a map of 128 bits (low, high): bit k % 128 for each key k."""

    def half(which: int) -> Column:
        bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k.bitwiseAND(63).cast("int"))
        keys = F.filter("keys", lambda k: k.bitwiseAND(64) == 64 * which)
        return F.aggregate(keys, F.lit(0).cast("long"), lambda bits, k: bits.bitwiseOR(bit(k)))

    return sets.withColumns({"low": half(0), "high": half(1)})


def _room(n: Column, m: Column) -> Column:
    """Shared tokens at most: those whose bits the other side (to_low, to_high) lacks aren't shared."""

    def left(size: Column, a: str, b: str) -> Column:
        return size - F.bit_count(F.col(f"{a}low").bitwiseAND(F.bitwise_not(f"{b}low"))) - F.bit_count(F.col(f"{a}high").bitwiseAND(F.bitwise_not(f"{b}high")))

    return F.least(left(n, "", "to_"), left(m, "to_", ""))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Later lines (doc_id, line_no) of pairs (with the earlier line in to_doc, to_line) whose sets are similar."""
    pairs = saved(pairs)
    few = F.broadcast if pairs.count() <= BROADCAST_ROWS else lambda df: df
    a = sets.select("doc_id", "line_no", F.col("keys").alias("kx")).join(few(pairs), ["doc_id", "line_no"])
    b = sets.select(F.col("doc_id").alias("to_doc"), F.col("line_no").alias("to_line"), F.col("keys").alias("ky")).join(few(pairs), ["to_doc", "to_line"])
    both = F.size(F.array_intersect("kx", "ky"))
    near = a.join(b, ["doc_id", "line_no", "to_doc", "to_line"])
    return near.where(100 * both >= PERCENT * (F.size("kx") + F.size("ky") - both)).select("doc_id", "line_no").distinct()


def _recurring(first: DataFrame, shares: np.ndarray) -> DataFrame:
    """Prefix tokens that may make a pair: (token, doc_id, line_no, n, i), the earliest line that has the token (to_doc,
    to_line, m, j), and whether more than two lines have it (many).

    A hot token is dealt over several tasks, each with an earliest line of its own; its rows all go on.
    """
    pack = F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("i") + 1)  # one number to shuffle
    rows = first.select("doc_id", "line_no", "n", F.posexplode("prefix").alias("i", "token")).select("token", "doc_id", "line_no", pack.alias("ni"))
    keys, hot = ["token"], F.lit(False)
    if shares.max() > 1:
        share = F.get(_listed(shares, "int"), _cell(F.col("token")))
        rows = rows.withColumn("part", F.when(share > 1, F.pmod(F.hash("doc_id", "line_no"), share)).otherwise(0))
        keys, hot = ["token", "part"], share > 1
    of_token = Window.partitionBy(*keys).orderBy("doc_id", "line_no")
    whole = of_token.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = of_token.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("alike", F.count("*").over(whole)).where((F.col("alike") > 1) | hot)  # most go here, before the rest is worked out
    rows = rows.withColumns({"p": F.first(F.struct("doc_id", "line_no", "ni")).over(upto), "next": F.lead("ni").over(of_token)})
    n, i = lambda c: F.shiftright(c, 32).cast("int"), lambda c: c.bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
    rows = rows.withColumn("many", (F.col("alike") > 2) | hot)
    met = rows.select(
        "token", "doc_id", "line_no", n(F.col("ni")).alias("n"), i(F.col("ni")).alias("i"), F.col("p.doc_id").alias("to_doc"), F.col("p.line_no").alias("to_line"),
        n(F.col("p.ni")).alias("m"), i(F.col("p.ni")).alias("j"), "many", F.coalesce(_may_match(n(F.col("ni")), i(F.col("ni")), n(F.col("next")), i(F.col("next"))), F.lit(False)).alias("ahead"),
    )
    # of two lines that share a token, neither goes on if they can't be similar
    behind = _may_match(*map(F.col, "nimj")) & ((F.col("doc_id") != F.col("to_doc")) | (F.col("line_no") != F.col("to_line")))
    return met.where(F.col("many") | F.col("ahead") | behind).drop("ahead")


def find_first_lines(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs(doc_id, text) -> (classes(doc_id, line_no) of first lines, later(doc_id, line_no) of those with an earlier match)."""
    keyed = _lines(docs).select("doc_id", "line_no", F.sort_array(F.array_distinct(_tokens(F.col("line")))).alias("keys"))
    sealed = keyed.select(F.xxhash64("keys").alias("a"), F.hash("keys").alias("b"), F.size("keys").alias("n"), F.struct("doc_id", "line_no").alias("id"), _prefix(F.col("keys")).alias("prefix"))
    first = sealed.groupBy("a", "b", "n").agg(F.min("id").alias("id"), F.min_by("prefix", "id").alias("prefix"))
    first = saved(first.select("id.doc_id", "id.line_no", "n", "prefix"))
    tokens = first.select(F.explode("prefix").alias("h"))
    counts = _cells(tokens)
    met = saved(_recurring(_frequent_last(first, docs, tokens, counts), _shares(counts)))
    line, to = ["doc_id", "line_no"], ["to_doc", "to_line"]
    near = _may_match(F.col("n"), F.col("i"), F.col("m"), F.col("j"))
    other = (F.col("doc_id") != F.col("to_doc")) | (F.col("line_no") != F.col("to_line"))

    def pairs_of(tokens: DataFrame) -> DataFrame:
        """Pairs by their shared prefix tokens: these and what may come after the last of them must do."""
        pairs = tokens.groupBy(*line, *to).agg(F.count("*").alias("shared"), F.first("n").alias("n"), F.max("i").alias("i"), F.first("m").alias("m"), F.max("j").alias("j"), F.first("room").alias("room"))
        enough = F.col("shared") + F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j")) >= _needed(F.col("n"), F.col("m"))
        return pairs.where(enough).select(*line, *to, "shared", (F.col("room") / (F.col("n") + F.col("m"))).alias("share"))

    own = ["token", *line, "n", "i", *to, "m", "j", "room"]
    found = saved(met.where(near & other).groupBy(*line, *to).agg(F.count("*").alias("shared")))
    star = found.groupBy(*line).agg(F.max_by(F.struct(*to), F.struct("shared", *to)).alias("p")).select(*line, "p.*")
    lines = _lines_at(docs, met.select(*line).distinct())
    sets = saved(_with_bits(lines.select(*line, F.array_distinct(_tokens(F.col("line"))).alias("keys"))))  # compared as sets, so no order is made
    bits = sets.select(*line, "low", "high")
    settled = cut(_verified(star, sets))
    # lines without a match so far meet the other earliest lines of their tokens, and of tokens of more lines those of a
    # near band of lengths
    width = math.log(100 / PERCENT)
    band = lambda n: F.floor(F.log(F.col(n).cast("double")) / width).cast("int")
    many = met.where("many")
    late = many.join(settled, line, "left_anti").join(bits, line).select("token", *line, "n", "i", "low", "high", F.explode(F.array(*[band("n") + k for k in (-1, 0, 1)])).alias("band"))
    mapped = many.join(bits, line).withColumns({"to_low": F.col("low"), "to_high": F.col("high")})
    early = mapped.select("token", band("n").alias("band"), F.col("doc_id").alias("to_doc"), F.col("line_no").alias("to_line"), F.col("n").alias("m"), F.col("i").alias("j"), "to_low", "to_high")
    before = (F.col("to_doc") < F.col("doc_id")) | ((F.col("to_doc") == F.col("doc_id")) & (F.col("to_line") < F.col("line_no")))  # a struct each would be made per pair
    tokens = late.join(early, ["token", "band"]).where(before & near).withColumn("room", _room(F.col("n"), F.col("m"))).where(F.col("room") >= _needed(F.col("n"), F.col("m"))).select(*own)
    tokens = tokens.union(met.where(~F.col("many") & near & other).join(settled, line, "left_anti").withColumn("room", F.least("n", "m")).select(*own))
    pairs = saved(pairs_of(tokens).join(star, [*line, *to], "left_anti"))
    # most lines are settled by their likeliest partner, the others meet all
    likeliest = saved(pairs.groupBy(*line).agg(F.max_by(F.struct(*to), F.struct("share", "shared", *to)).alias("p")).select(*line, "p.*"))
    by_likeliest = cut(_verified(likeliest, sets))
    rest = pairs.select(*line, *to).join(by_likeliest, line, "left_anti").join(likeliest, [*line, *to], "left_anti")
    later = settled.union(by_likeliest).union(_verified(rest, sets))
    return first.select(*line), later


def _one_per_id(texts: DataFrame) -> DataFrame:
    """texts(doc_id, text) with one row for each id: where rows share an id, the smallest text."""
    again = cut(texts.groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1").select("doc_id"))
    if again.isEmpty():
        return texts
    return texts.join(again, "doc_id", "left_anti").union(texts.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document id: doc_id, n_lines, n_removed and kept_lines (places of the lines that stay, in order).

    Lines are cut at line feeds. Defined results: null and empty texts have no lines; lines without words
    are not counted and never removed; of rows that share an id the smallest text counts (a null
    only if there is no other); rows whose id is null are left out, as they have no place in the order. Other
    columns are not looked at.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where("doc_id is not null")
    texts = _one_per_id(texts)
    first, later = find_first_lines(texts)
    kept = first.join(later, ["doc_id", "line_no"], "left_anti").groupBy("doc_id").agg(F.sort_array(F.collect_list("line_no")).alias("kept_lines"))
    sizes = texts.select("doc_id", F.size(F.filter(F.split("text", "\n"), _has_word)).cast("long").alias("n_lines"))
    return sizes.join(kept, "doc_id", "left").select(
        "doc_id", "n_lines", (F.col("n_lines") - F.coalesce(F.size("kept_lines"), F.lit(0))).alias("n_removed"), F.coalesce("kept_lines", F.array().cast("array<int>")).alias("kept_lines")
    )


def drop_later_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with texts of the lines that stay (and of those without words), joined by line feeds.

    Rows whose id is null, and null texts, stay as they are; of rows that share an id each keeps the places
    that stay in the text that counts.
    """
    kept = dedup_lines(docs, id_col=id_col, text_col=text_col).select(F.col("doc_id").alias("__id"), F.col("kept_lines").alias("__kept"))
    lines = F.filter(F.split(F.col(text_col), "\n"), lambda x, i: ~_has_word(x) | F.array_contains("__kept", i))
    return docs.join(kept, F.col(id_col) == F.col("__id"), "left").withColumn(text_col, F.when(F.col("__id").isNull(), F.col(text_col)).otherwise(F.array_join(lines, "\n"))).drop("__id", "__kept")
