"""Mixing sources to target weights: equal-token blocks apportioned by Sainte-Laguë, then chosen by seed."""

from __future__ import annotations

import heapq
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def pieces(text: str, pattern, size: int = 1_000_000):
    """A long text in pieces of about ``size`` characters, cut only where a match of the pre-tokenising pattern begins with a
    space after a letter or digit: no match reaches or looks across such a place, so the pieces have the tokens of the whole."""
    if len(text) <= size:
        yield text
        return
    start = 0
    for m in pattern.finditer(text):
        at = m.start()
        if at - start >= size and text[at] == " " and text[at - 1].isalnum() and m.end() > at + 1:
            yield text[start:at]
            start = at
    yield text[start:]


def token_counts(df: DataFrame, key: str, text: str, tokenizer: str, pattern: str) -> DataFrame:
    """Tokens of every text by a byte-pair vocabulary given as ranks, in one pass without a shuffle; null texts have 0.

    The vocabulary file is read on the driver and sent to the tasks; its size is that of the vocabulary.
    """
    with open(tokenizer, "rb") as f:
        vocabulary = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        import base64

        import pyarrow as pa
        import regex
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.value.splitlines())}
        enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        own = regex.compile(pattern)
        for b in batches:
            n = [0 if t is None else sum(len(enc.encode_ordinary(p)) for p in pieces(t, own)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64())], names=["id", "source", "tokens"])

    return df.mapInArrow(run, "id bigint, source string, tokens bigint")


def canonical_source(c: Column) -> Column:
    """One spelling of a source name: lower case, words joined by one underscore."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "_"), "^_+|_+$", "")


def apportion(shares: dict[str, Fraction], caps: dict[str, int], seats: int) -> dict[str, int]:
    """Blocks per source by highest quotients share/(2k+1) (Sainte-Laguë), no source beyond its cap; ties go to the name.

    All blocks whose quotient is above a bound are given at once, the bound found by
    halving, so the work doesn't grow with the blocks; only the last few are taken singly.
    """
    live = {s: w for s, w in shares.items() if w > 0 and caps.get(s, 0) > 0}
    got = dict.fromkeys(shares, 0)
    at = lambda x: {s: min(caps[s], int(w * x + Fraction(1, 2))) for s, w in live.items()}
    if live and seats > 4 * len(live):
        low, high = Fraction(0), Fraction(2 * seats) / min(live.values())
        for _ in range(200):
            mid = (low + high) / 2
            mid = mid.limit_denominator(10**6)
            if sum(at(mid).values()) <= max(0, seats - len(live)):
                low = mid
            else:
                high = mid
            if high - low < Fraction(1, 100):
                break
        got |= at(low)
        seats -= sum(got.values())
    heap = [(-w / (2 * got[s] + 1), s) for s, w in live.items() if got[s] < caps[s]]
    heapq.heapify(heap)
    while seats > 0 and heap:
        _, s = heapq.heappop(heap)
        got[s] += 1
        seats -= 1
        if got[s] < caps[s]:
            heapq.heappush(heap, (-shares[s] / (2 * got[s] + 1), s))
    return got


def largest_total(shares: dict[str, Fraction], caps: dict[str, int]) -> int:
    """Most blocks at which every source that has any stays within its cap at its share of the whole."""
    live = {s: w for s, w in shares.items() if w > 0 and caps.get(s, 0) > 0}
    if not live:
        return 0
    total = sum(live.values())
    return max(1, int(min(Fraction(caps[s]) * total / w for s, w in live.items())))


def mix(docs: DataFrame, key: str, text: str, source: str, targets: DataFrame, tokenizer: str, pattern: str, block_tokens: int = 2_000, shard_tokens: int = 20_000_000, seed: int = 17) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A mixture of documents near the target shares, by tokens.

    Documents of one source are dealt into shards by a seeded hash of their key (as many as
    hold ``shard_tokens``), ordered by a second hash within each, and laid into blocks of
    ``block_tokens`` tokens, so no window spans more than one shard. The number of blocks
    of each source at which all keep their shares within ``max_repeats`` is apportioned by
    Sainte-Laguë, then each source's quota over its shards in proportion to their
    blocks, in a task per source. A quota beyond the blocks there are takes every block whole times over and the
    rest by seeded order; so a document comes at most ``max_repeats`` times. Only sums per
    source come to the driver.

    Sources are compared in one spelling. Documents with a null or unlisted source are in
    no mixture, those with null or blank text have no tokens and are left out. A target
    without documents gets nothing; the other shares keep their proportions. Rows of one
    key count once. Targets with a null or negative share count as 0, a null max_repeats
    as 1. An empty table gives an empty mixture.

    Returns (chosen: key, source, tokens, repeats; report: source, target_share, tokens_available,
    blocks, tokens_taken, share_reached, max_repeats, repeats_used; counts: id, source, tokens).
    """
    from gleanery.sources.tables import checkpoint

    rows = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"), canonical_source(F.col(source)).alias("source"))
    rows = rows.where("id is not null")
    counts = checkpoint(token_counts(rows, "id", "text", tokenizer, pattern).dropDuplicates(["id"]))
    goal = {}
    for r in targets.select(canonical_source(F.col("source")).alias("s"), "target_share", "max_repeats").where("s is not null").orderBy("s").collect():
        goal[r.s] = (Fraction(max(0.0, r.target_share or 0.0)).limit_denominator(10**9), max(1, r.max_repeats or 1))
    listed = counts.where(F.col("source").isin(*goal) & (F.col("tokens") > 0)) if goal else counts.where(F.lit(False))
    sums = {r.source: r.n for r in listed.groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
    shards = {s: max(1, -(-n // shard_tokens)) for s, n in sums.items()}
    spark = docs.sparkSession
    number = F.coalesce(*[F.when(F.col("source") == s, F.lit(k)) for s, k in shards.items()], F.lit(1)) if shards else F.lit(1)
    order = Window.partitionBy("source", "shard").orderBy(F.xxhash64("id", F.lit(seed)), "id")
    laid = listed.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), "id"), number.cast("bigint")))
    laid = laid.withColumn("block", F.floor((F.sum("tokens").over(order) - F.col("tokens")) / block_tokens))
    laid = checkpoint(laid)
    sizes = laid.groupBy("source", "shard").agg((F.max("block") + 1).alias("n"))
    have = {r.source: r.n for r in sizes.groupBy("source").agg(F.sum("n").alias("n")).collect()}
    shares = {s: w for s, (w, _) in goal.items()}
    caps = {s: have.get(s, 0) * goal[s][1] for s in goal}
    quota = apportion(shares, caps, largest_total(shares, caps))
    repeats = {s: r for s, (_, r) in goal.items()}

    def deal(key, sizes_of):
        """A source's quota over its shards: one row per ``shard_tokens`` tokens, so a group stays small."""
        import pyarrow as pa

        s = key[0].as_py()
        own = dict(zip(sizes_of.column("shard").to_pylist(), sizes_of.column("n").to_pylist()))
        got = apportion({k: Fraction(n) for k, n in own.items()}, {k: n * repeats[s] for k, n in own.items()}, quota[s])
        return pa.table({"source": pa.array([s] * len(own), pa.string()), "shard": pa.array(list(own), pa.int64()), "quota": pa.array([got[k] for k in own], pa.int64()), "blocks": pa.array(list(own.values()), pa.int64())})

    quotas = sizes.groupBy("source").applyInArrow(deal, "source string, shard bigint, quota bigint, blocks bigint")
    # all blocks by number, also those in which no document begins: the mean of all is the block size
    pick = quotas.select("source", "shard", "quota", F.col("blocks").alias("n_blocks"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"))
    rank = Window.partitionBy("source", "shard").orderBy(F.xxhash64("block", F.lit(seed + 2)), "block")
    pick = pick.withColumn("k", F.row_number().over(rank) - 1)
    pick = pick.withColumn("repeats", (F.floor(F.col("quota") / F.col("n_blocks")) + F.when(F.col("k") < F.col("quota") % F.col("n_blocks"), 1).otherwise(0)).cast("int"))
    cap = F.coalesce(*[F.when(F.col("source") == s, F.lit(r)) for s, (_, r) in goal.items()], F.lit(1)) if goal else F.lit(1)
    pick = pick.withColumn("repeats", F.least("repeats", cap)).where("repeats > 0").select("source", "shard", "block", "repeats")
    chosen = laid.join(pick, ["source", "shard", "block"]).select(F.col("id").alias(key), "source", "tokens", "repeats")

    taken = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens_taken"), F.max("repeats").alias("repeats_used"))
    facts = spark.createDataFrame([(s, float(w), sums.get(s, 0), quota.get(s, 0), r) for s, (w, r) in goal.items()], "source string, target_share double, tokens_available bigint, blocks bigint, max_repeats int")
    got = F.coalesce("tokens_taken", F.lit(0))
    whole = F.sum(got).over(Window.partitionBy())  # one row per target
    report = facts.join(taken, "source", "left").select(
        "source", "target_share", "tokens_available", "blocks", got.alias("tokens_taken"),
        F.round(F.when(whole > 0, got / whole).otherwise(0.0), 6).alias("share_reached"), "max_repeats", F.coalesce("repeats_used", F.lit(0)).alias("repeats_used"),
    )
    return chosen, report, counts
