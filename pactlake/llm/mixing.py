"""Mixing sources to target weights.

A source with token share p gets the weight p^a / sum p^a. The exponent a is found by bisection so that the weights
meet a target entropy or so that no source repeats more often than a limit. A token budget then becomes passes over
each source: whole passes, each over a random permutation of the source's blocks of its own, and one pass that ends where the
budget does. The block in which it ends is cut the same way into smaller blocks, and the last of those row by row. The place
of a row in the mix follows from its block's place in the pass: read in that order, every stretch of the mix holds the sources
at about their weights, block after block. Tokens are those of a byte-level BPE file, counted once for each row and written.
"""

from __future__ import annotations

import math

import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactlake.llm.byte_bpe import SLICE_ROWS, codec_of
from pactlake.llm.common import discard, fresh, materialize

#: Blocks of a source's permutation, and of the block that is cut.
BLOCKS = 1024
#: Exponents that one pass over the sources tries: the interval shrinks by SECTIONS in each.
SECTIONS, ROUNDS = 16, 14
#: The vocabulary that counts, if no other is given: the one the pipeline encodes by.
RANKS = "byte_bpe_multi_50k.tiktoken"


def counted(docs: DataFrame, text_col: str = "text", ranks_path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> tuple[DataFrame, str]:
    """`docs` with _n_tokens, written, and its table's path. Only texts travel to Python; a null text has no tokens."""
    with open(ranks_path or public_tokenizers.path(RANKS), "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def count(texts: pa.Array) -> pa.Array:
        codec = codec_of(shared.value, pattern)
        return pa.array([n for at in range(0, len(texts), SLICE_ROWS) for n in codec.count_all(texts.slice(at, SLICE_ROWS))], pa.int64())

    n = F.arrow_udf(count, "long")
    return materialize(docs.withColumn("_n_tokens", n(F.col(text_col))), "mix-counted", batch=SLICE_ROWS)


class Shares:
    """Sums over the sources' token shares, made by Spark; decimal sums, so that no order of rows changes them."""

    def __init__(self, sources: DataFrame) -> None:
        some = sources.filter("tokens > 0")
        self.n, total, low, high = some.agg(F.count("*"), F.sum("tokens"), F.min("tokens"), F.max("tokens")).first()
        self.total, self.low, self.high = total or 0, low or 0, high or 0
        self.frame = some.select((F.col("tokens") / F.lit(max(self.total, 1))).alias("p"))

    def sums(self, exponents: list[float]) -> list[tuple[float, float]]:
        """(sum p^a, sum p^a ln p) for each a."""
        exact = lambda c: F.sum(c.cast("decimal(38, 18)"))
        w = [F.pow("p", F.lit(a)) for a in exponents]
        r = self.frame.agg(*[exact(x) for x in w], *[exact(x * F.log("p")) for x in w]).first()
        return [(float(x), float(y)) for x, y in zip(r[: len(w)], r[len(w) :], strict=True)]

    def entropies(self, exponents: list[float]) -> list[float]:
        return [math.log(z) - a * s / z for a, (z, s) in zip(exponents, self.sums(exponents), strict=True)]

    def repeats(self, a: float) -> float:
        """Most passes over a source while the least repeated one is read once."""
        return (self.high / self.low) ** (1 - a) if self.low else 1.0


def exponent(shares: Shares, entropy: float | None, repetition_limit: float | None) -> float:
    """The exponent in [0, 1] that meets the target; a target out of reach gives the nearer end.

    Entropy and repetition fall as the exponent grows. With `entropy` (nats) the largest exponent whose weights have at
    least that entropy is taken, with `repetition_limit` the smallest one that keeps to the limit.
    """
    if (entropy is None) == (repetition_limit is None):
        raise ValueError("give either a target entropy or a repetition limit")
    if shares.n < 2:
        return 1.0
    if entropy is not None:
        above = lambda tries: [h >= entropy for h in shares.entropies(tries)]
    else:
        above = lambda tries: [shares.repeats(a) > repetition_limit for a in tries]
    low, high = 0.0, 1.0
    first, last = above([low, high])
    if not first:
        return low
    if last:
        return high
    for _ in range(ROUNDS):
        tries = [low + (high - low) * k / SECTIONS for k in range(1, SECTIONS)]
        held = above(tries)
        k = held.index(False) if False in held else len(tries)
        low, high = (tries[k - 1] if k else low), (tries[k] if k < len(tries) else high)
    return low if entropy is not None else high


def _block(columns: list[Column], seed: int) -> Column:
    """A row's place in the permutation of its source's blocks: (a hash of the block, the block)."""
    block = F.pmod(F.xxhash64(*columns, F.lit(seed)), F.lit(BLOCKS)).cast("int")
    return F.struct(F.xxhash64(block, F.lit(seed)).alias("h"), block.alias("b"))


def _cut(rows: DataFrame, room: DataFrame) -> DataFrame:
    """(source, cut, room): the block of each source in which the pass of `room` tokens ends, and what is left for it.

    `rows`: source, at (place of the block), n (tokens); a source's blocks before the cut hold `room` tokens or fewer.
    """
    blocks = rows.groupBy("source", "at").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("source").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    room = room.select(F.col("source").alias("s"), "room")
    ended = blocks.withColumn("upto", upto).join(room, F.col("source").eqNullSafe(F.col("s"))).filter("upto > room")
    first = ended.groupBy("source").agg(F.min(F.struct("at", (F.col("room") - F.col("upto") + F.col("n")).alias("room"))).alias("c"))
    return first.select("source", F.col("c.at").alias("cut"), F.col("c.room").alias("room"))


def plan(keyed: DataFrame, entropy: float | None = None, repetition_limit: float | None = 2.0, budget_tokens: int | None = None, budget_share: float | None = None) -> tuple[DataFrame, str]:
    """One row for each source of `keyed` (source, at, inner, n): weight, passes, room, rate (passes with the partial one); cut and
    inner_cut, the blocks in which the last, partial pass ends, and inner_room, the tokens it takes of the inner one. Also its
    table's path.

    `budget_share` is a budget in shares of all tokens. Without a budget it is the least that reads every source in full once.
    """
    sources, p_sources = materialize(keyed.groupBy("source").agg(F.sum("n").alias("tokens")), "mix-sources")
    shares = Shares(sources)
    a = exponent(shares, entropy, repetition_limit if entropy is None else None)
    z = shares.sums([a])[0][0] if shares.n else 1.0
    p = F.col("tokens") / F.lit(max(shares.total, 1))
    weight = F.when(F.col("tokens") > 0, F.pow(p, F.lit(a)) / F.lit(z)).otherwise(F.lit(0.0))
    # Tokens over weight is largest for the largest source, as the exponent is 1 at most.
    top = shares.high / shares.total if shares.total else 1.0
    if budget_share is not None:
        budget_tokens = int(budget_share * shares.total)
    budget = float(budget_tokens) if budget_tokens is not None else (shares.high * z / top**a if shares.n else 0.0)
    quota = F.round(F.lit(budget) * F.col("weight") * (1 + 1e-12), 3)
    some = F.col("tokens") > 0
    s = sources.withColumn("weight", weight)
    s = s.withColumn("passes", F.when(some, F.floor(quota / F.col("tokens"))).otherwise(F.lit(1 if budget_tokens is None else 0)).cast("long"))
    s = s.withColumn("rate", F.when(some, quota / F.col("tokens")).otherwise(F.col("passes").cast("double")))
    s, p_shares = materialize(s.withColumn("room", F.floor(F.when(some, quota).otherwise(F.lit(0.0)) - F.col("passes") * F.col("tokens")).cast("long")), "mix-shares")
    cut, p_cut = materialize(_cut(keyed, s), "mix-cut")
    ends = cut.select(F.col("source").alias("s"), "cut")
    inside = keyed.join(ends, F.col("source").eqNullSafe(F.col("s")) & (F.col("at") == F.col("cut"))).select("source", F.col("inner").alias("at"), "n")
    inner = _cut(inside, cut).select(F.col("source").alias("t"), F.col("cut").alias("inner_cut"), F.col("room").alias("inner_room"))
    made = s.join(ends, F.col("source").eqNullSafe(F.col("s")), "left").drop("s").join(inner, F.col("source").eqNullSafe(F.col("t")), "left").drop("t")
    table, kept = materialize(made, "mix-plan")
    discard(keyed.sparkSession, p_sources, p_shares, p_cut)
    return table, kept


def _place(block: Column, n: Column, passes: Column, rate: Column, seed: int) -> Column:
    """Where in the mix, from 0 to 1, pass number n of a source reads a block."""
    h = F.when(n <= passes, F.xxhash64(block["b"], F.lit(seed), n.cast("long"))).otherwise(block["h"])
    return F.least((n - 1 + h / F.lit(2.0**64) + 0.5) / F.greatest(rate, F.lit(1e-9)), F.lit(1.0))


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 11, ranks_path: str | None = None, pattern: str = public_tokenizers.PATTERN, **targets) -> DataFrame:
    """`docs` with _n_tokens, _weight, _copies, how often the mix holds each row, and _places, where each of them stands.

    A null source is a source of its own. Null and empty texts have no tokens; they ride along with every whole pass of
    their source. The last rows of a partial pass are taken in the order of a hash of their ids; rows with the same id and
    text are ties and are taken together or not at all. Columns of `docs` named as those four are replaced; other columns
    stay as they are, whatever their names. An empty table gives an empty result.
    """
    docs, _ = counted(docs.drop("_n_tokens", "_weight", "_copies", "_places"), text_col, ranks_path, pattern)
    at, inner = _block([F.col(id_col)], seed), _block([F.col(id_col), F.lit("inner")], seed + 1)
    keyed = docs.select(F.col(source_col).alias("source"), at.alias("at"), inner.alias("inner"), F.col("_n_tokens").alias("n"))
    made, _ = plan(keyed, **targets)
    names = ["source", "weight", "passes", "cut", "inner_cut", "inner_room", "rate"]
    s, weight, passes, cut, inner_cut, room, rate, place, inner_place, upto = fresh(docs, *("_" + n for n in names), "_place", "_inner_place", "_upto")
    # One row a source; Spark broadcasts the plan where it is small and else joins by shuffle.
    made = made.select([F.col(x).alias(y) for x, y in zip(names, (s, weight, passes, cut, inner_cut, room, rate), strict=True)])
    rows = docs.withColumns({place: at, inner_place: inner}).join(made, F.col(source_col).eqNullSafe(F.col(s)))
    ends = F.coalesce((F.col(place) == F.col(cut)) & (F.col(inner_place) == F.col(inner_cut)), F.lit(False))
    before = F.coalesce((F.col(place) < F.col(cut)) | (F.col(place) == F.col(cut)) & (F.col(inner_place) < F.col(inner_cut)), F.lit(False))
    ties = Window.partitionBy(s).orderBy(F.xxhash64(F.lit(seed), F.col(id_col)), F.col(id_col), F.xxhash64(text_col)).rangeBetween(Window.unboundedPreceding, 0)
    part = rows.filter(ends).withColumn(upto, F.sum("_n_tokens").over(ties))
    extra = lambda taken: F.col(passes) + (taken & (F.col("_n_tokens") > 0)).cast("int")
    out = rows.filter(~ends).withColumn("_copies", extra(before)).unionByName(part.withColumn("_copies", extra(F.col(upto) <= F.col(room))).drop(upto))
    each = F.when(F.col("_copies") > 0, F.sequence(F.lit(1), F.col("_copies").cast("int"))).otherwise(F.array().cast("array<int>"))
    places = F.transform(each, lambda n: _place(F.col(place), n, F.col(passes), F.col(rate), seed))
    return out.select(*docs.columns, F.col(weight).alias("_weight"), "_copies", places.alias("_places"))


def realise(docs: DataFrame, with_place: bool = False, **options) -> DataFrame:
    """The mix itself: every row of `docs` as often as the weights ask for, columns unchanged (a clashing name included).

    With `with_place` also _place: sorted by it the mix is in the order of its blocks.
    """
    names = docs.columns
    held = [f"c{i}" for i in range(len(names))]
    options = {"id_col": "doc_id", "text_col": "text", "source_col": "source"} | options
    own = {k: held[names.index(v)] if k.endswith("_col") else v for k, v in options.items()}
    found = copies(docs.toDF(*held), **own).filter("_copies > 0")
    out = found.select(*held, F.explode("_places").alias("_place"))
    return out.toDF(*names, "_place") if with_place else out.select(held).toDF(*names)
