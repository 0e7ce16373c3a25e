"""Mixing of sources to target weights by temperature.

A source's weight is its share of all tokens, raised to an exponent and normalised.  The exponent is found
by bisection, four halvings a job: the least one that keeps the weights' entropy at or below a target,
or that repeats no source more often than a limit.  Weights become token quotas of a budget, and quotas are
realised by permutations: each epoch orders a source's documents by a digest of seed, epoch and id; whole
epochs are taken as they are, the last one as far as the quota reaches.  Digests also deal the documents
of every source evenly over the blocks of the stream, so that each block has about the target weights.

Without a budget it is the least one that takes every document once at least.

Built of DataFrame functions only.  A source's last epoch is cut with sums per block of its permutation
first, and by single documents in the block where the quota ends: no task gets a source's documents.

Defined results: a document's tokens are its words and one end token, so a null or empty text has one; a
null source is a source of its own; documents with equal ids are taken together; a null id is an id; an
empty table gives an empty result.  Columns whose names begin with ``_llm_`` are reserved, all others kept
by ``mixed_rows``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelstats.shared import stored

WORDS = r"[^\x20\x09-\x0D]+"
#: Blocks of the mixed stream.
STREAM_BLOCKS = 1024
#: Points between the ends of a bracket, and jobs: 15 points are four halvings.
POINTS, JOBS = 15, 8
DIGITS = 6


@dataclass(frozen=True)
class Mix:
    """Either limit: ``entropy`` in nats, or ``repeats`` of any source.  ``budget`` in tokens, or None."""

    repeats: float | None = 2.0
    entropy: float | None = None
    budget: int | None = None
    seed: str = "mix"


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long") + 1


def order_digest(seed: str, epoch: Column, doc_id: Column) -> Column:
    """Place of a document in the permutation of an epoch, as 32 hexadecimal digits."""
    return F.md5(F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("-"))


def exponent(totals: DataFrame, how: Mix) -> float:
    """Least exponent in [0, 1] within the limit, rounded up to ``DIGITS`` places.

    A job reduces all sources at all points of the bracket to three sums a point.  Entropy falls with the
    exponent's growth, and so does the repetition of the smallest source.
    """
    whole = totals.agg(F.sum("tokens").alias("all"), F.min("tokens").alias("low"), F.max("tokens").alias("high")).first()
    if not whole["all"]:
        return 1.0
    share = F.col("tokens") / F.lit(float(whole["all"]))

    def fits(points: list[float]) -> list[bool]:
        each = totals.select(share.alias("p"), F.explode(F.array(*map(F.lit, points))).alias("a"))
        power = F.pow("p", F.col("a"))
        sums = each.groupBy("a").agg(F.sum(power).alias("z"), F.sum(power * F.log("p")).alias("zl")).collect()
        found = {}
        for a, z, zl in sums:
            entropy = math.log(z) - a * zl / z
            low, high = (whole[k] / whole["all"] for k in ("low", "high"))
            repeats = (high / low) ** (1 - a) if how.budget is None else low ** (a - 1) / z * how.budget / whole["all"]
            found[a] = entropy <= how.entropy if how.entropy is not None else repeats <= how.repeats
        return [found[a] for a in points]

    at_0, at_1 = fits([0.0, 1.0])
    if at_0 or not at_1:
        return 0.0 if at_0 else 1.0
    a, b = 0.0, 1.0
    for _ in range(JOBS):
        points = [a + (b - a) * i / (POINTS + 1) for i in range(1, POINTS + 1)]
        ok = fits(points)
        first = next((i for i, good in enumerate(ok) if good), POINTS)
        a, b = ([a, *points][first], [*points, b][first])
    return min(1.0, math.ceil(b * 10**DIGITS) / 10**DIGITS)


def plan(docs: DataFrame, how: Mix, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Per source: _llm_key, tokens, weight, quota, epochs (whole ones) and cut (digest of the last document
    of the epoch after them, null if none of it is taken)."""
    lengths = stored(
        docs.select(F.col(id_col).alias("id"), _key(F.col(source_col)).alias("_llm_key"), n_tokens(F.col(text_col)).alias("n")), "mixing-lengths"
    )
    totals = stored(lengths.groupBy("_llm_key").agg(F.sum("n").alias("tokens")), "mixing-sources")
    power = exponent(totals, how)
    sums = totals.agg(F.sum("tokens").alias("all")).first()["all"] or 1
    raised = totals.withColumn("raised", F.pow(F.col("tokens") / F.lit(float(sums)), F.lit(power)))
    norm = raised.agg(F.sum("raised").alias("z"), F.max(F.col("tokens") / F.col("raised")).alias("most")).first()
    z = norm["z"] or 1.0
    budget = float(how.budget) if how.budget is not None else (norm["most"] or 0.0) * z
    weighted = raised.withColumn("weight", F.col("raised") / F.lit(z))
    quotas = stored(
        weighted.withColumn("quota", F.round(F.col("weight") * F.lit(budget)).cast("long"))
        .withColumn("epochs", F.floor(F.col("quota") / F.col("tokens")).cast("int"))
        .withColumn("rest", F.col("quota") - F.col("epochs") * F.col("tokens"))
        .drop("raised"),
        "mixing-quotas",
    )

    last = lengths.join(quotas.filter(F.col("rest") > 0).select("_llm_key", "epochs", "rest"), "_llm_key")
    last = last.withColumn("digest", order_digest(how.seed, F.col("epochs"), F.col("id")))
    last = last.select("_llm_key", "rest", "n", "digest", F.substring("digest", 1, 3).alias("block"))
    ahead = Window.partitionBy("_llm_key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = last.groupBy("_llm_key", "rest", "block").agg(F.sum("n").alias("n"))  # 4096 blocks a source at most
    blocks = blocks.withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    ends = blocks.filter((F.col("before") < F.col("rest")) & (F.col("before") + F.col("n") >= F.col("rest")))
    inside = last.join(ends.select("_llm_key", "block", "before"), ["_llm_key", "block"])
    upto = Window.partitionBy("_llm_key").orderBy("digest").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    reached = inside.withColumn("upto", F.col("before") + F.sum("n").over(upto)).filter(F.col("upto") >= F.col("rest"))
    cuts = reached.groupBy("_llm_key").agg(F.min("digest").alias("cut"))
    return stored(quotas.join(cuts, "_llm_key", "left"), "mixing-plan")


def mixed_rows(
    docs: DataFrame, how: Mix = Mix(), id_col: str = "doc_id", source_col: str = "source", text_col: str = "text"
) -> DataFrame:
    """Rows of ``docs`` as often as the mix takes them, with _llm_epoch and _llm_block (of the stream).

    Texts aren't moved if the plan, a row a source, is small enough for Spark to broadcast.
    """
    sources = plan(docs, how, id_col, source_col, text_col).select(
        "_llm_key", *(F.col(n).alias(f"_llm_{n}") for n in ("tokens", "quota", "epochs", "cut"))
    )
    rows = docs.withColumn("_llm_key", _key(F.col(source_col))).join(sources, "_llm_key")
    epoch = F.col("_llm_epoch")
    digest = order_digest(how.seed, epoch, F.col(id_col))
    each = rows.withColumn("_llm_epoch", F.explode(F.sequence(F.lit(0), F.col("_llm_epochs"))))
    taken = each.withColumn("_llm_digest", digest).filter((epoch < F.col("_llm_epochs")) | (F.col("_llm_digest") <= F.col("_llm_cut")))
    part = F.conv(F.substring("_llm_digest", 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    place = (epoch + part) * F.col("_llm_tokens") / F.col("_llm_quota") * F.lit(float(STREAM_BLOCKS))
    block = F.least(F.floor(place), F.lit(STREAM_BLOCKS - 1)).cast("int")
    return taken.select(*docs.columns, "_llm_epoch", block.alias("_llm_block"))


def mix(docs: DataFrame, how: Mix = Mix(), id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Per document and epoch that takes it: doc_id, source, n_tokens, epoch, block."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    taken = mixed_rows(rows, how, "doc_id", "source", "text")
    return taken.select("doc_id", "source", n_tokens(F.col("text")).alias("n_tokens"), F.col("_llm_epoch").alias("epoch"), F.col("_llm_block").alias("block"))


def mix_sql(repeats: float = 2.0, seed: str = "mix", documents: str = "documents") -> str:
    """The rows of ``mix`` with a repetition limit and no budget, for DuckDB.

    Without a budget the repetition of source i is ``(largest / own share) ** (1 - exponent)``, so the
    least exponent within the limit has a closed form.
    """
    return f"""
with lengths as (
  select doc_id, source, coalesce('=' || source, '-') as k, coalesce(cast(doc_id as varchar), 'null') as shown,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) + 1 as n
  from {documents}
), totals as (
  select k, cast(sum(n) as bigint) as tokens from lengths group by k
), whole as (
  select cast(sum(tokens) as double) as total, min(tokens) as low, max(tokens) as high from totals
), chosen as (
  select total, case when low = high or high / low::double <= {repeats} then 0.0
    else ceil((1 - ln({repeats}::double) / ln((high / total) / (low / total))) * 1e6) / 1e6 end as a from whole
), raised as (
  select k, tokens, pow(tokens / total, a) as raised from totals, chosen
), norm as (
  select sum(raised) as z, max(tokens / raised) as most from raised
), quotas as (
  select k, tokens, cast(round((raised / z) * (most * z)) as bigint) as quota from raised, norm
), sources as (
  select *, cast(floor(quota / tokens::double) as integer) as epochs, quota - cast(floor(quota / tokens::double) as bigint) * tokens as rest from quotas
), each as (
  select doc_id, source, n, shown, k, tokens, quota, epochs, rest, unnest(range(0, epochs + 1)) as epoch from lengths join sources using (k)
), digests as (
  select *, md5('{seed}:' || epoch || ':' || shown) as digest from each
), placed as (
  select *, sum(n) over (partition by k, epoch order by digest) - sum(n) over (partition by k, epoch, digest) as before from digests
)
select doc_id, source, n as n_tokens, cast(epoch as integer) as epoch,
  cast(least(floor((epoch + cast(('0x' || substr(digest, 1, 8)) as bigint)::double / 4294967296.0) * tokens / quota * {STREAM_BLOCKS}.0),
       {STREAM_BLOCKS - 1}) as integer) as block
from placed where epoch < epochs or before < rest"""
