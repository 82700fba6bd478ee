"""Mixing sources to target weights by entropy balancing.

Each document gets a rate ``min(cap_s, exp(b_s * n / mean_s))`` by its source ``s`` and its tokens ``n``: of all rates up to the cap under which every source has
its share of the tokens, the nearest to one in relative entropy. A source that is thinned out thus keeps more of its short documents, and one that is
repeated repeats its long ones more. The dual has one number per source; Newton's steps need two sums per source, which each iteration gathers over all documents
(reduced to counts per source and length beforehand). Rates are then rounded into copies: the whole part goes to every document, and one more to the documents
that come first by a hashed number over the rest of their rate (so that rest is how likely they get it), up to the token that
fills the share; one document is picked by its length, to fill what is left.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.tokens import DEFAULT_TOKENIZER, count_tokens
from quern.plans.materialize import materialize

BUCKETS = 65_536
MAX_STEPS, TOLERANCE = 100, 1e-9


def source_name(source: Column) -> Column:
    """A source's name without case and outer blanks."""
    return F.lower(F.regexp_replace(source, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))


@dataclass
class Target:
    share: float
    #: copies a document may have at most; None: no bound
    cap: int | None


def read_targets(targets: DataFrame, max_targets: int = 10_000) -> dict[str, Target]:
    """The target table as a dictionary; rows of one name add up their shares and take the smaller cap. Nameless rows and shares that aren't positive are left out."""
    rows = targets.select(source_name(F.col("source")).alias("s"), "target_share", "max_repeats").filter("s is not null and target_share > 0").limit(max_targets + 1).collect()
    if len(rows) > max_targets:
        raise ValueError(f"more than {max_targets} target rows")
    out: dict[str, Target] = {}
    for r in rows:
        had = out.get(r["s"], Target(0.0, None))
        caps = [c for c in (had.cap, r["max_repeats"]) if c is not None]
        out[r["s"]] = Target(had.share + r["target_share"], min(caps) if caps else None)
    return out


def planned_tokens(sizes: dict[str, int], targets: dict[str, Target], total: int | None) -> dict[str, float]:
    """Tokens that each source should give. Shares of absent sources go to the others in proportion.

    Without ``total`` the mix is as large as all caps permit with every share met (the corpus's size if no cap binds). With it, sources whose cap doesn't reach give
    all they can, and the others share the rest in proportion to their targets.
    """
    have = {s: n for s, n in sizes.items() if n > 0 and s in targets and (targets[s].cap is None or targets[s].cap > 0)}
    if not have:
        return {}
    weight = sum(targets[s].share for s in have)
    reach = {s: float("inf") if targets[s].cap is None else float(targets[s].cap * n) for s, n in have.items()}
    if total is None:
        most = min(reach[s] * weight / targets[s].share for s in have)
        whole = most if np.isfinite(most) else float(sum(have.values()))
        return {s: whole * targets[s].share / weight for s in have}
    plan: dict[str, float] = {}
    open_, rest = set(have), float(total)
    while open_:
        weight = sum(targets[s].share for s in open_)
        full = {s for s in open_ if rest * targets[s].share / weight >= reach[s]}
        if not full:
            return plan | {s: rest * targets[s].share / weight for s in open_}
        plan |= {s: reach[s] for s in full}
        rest -= sum(reach[s] for s in full)
        open_ -= full
    return plan


def tilted_rate(slope: Column, length: Column, cap: Column) -> Column:
    """A document's rate; ``length`` in mean lengths, a null ``cap`` is no bound. No solution has exponents near 50."""
    return F.least(F.exp(F.least(slope * length, F.lit(50.0))), F.coalesce(cap.cast("double"), F.lit(float("inf"))))


def balance(lengths: DataFrame, plan: dict[str, float], caps: dict[str, int | None]) -> dict[str, tuple[float, float]]:
    """Newton's iterations on the dual: ``b`` and the mean length for each source. ``lengths``: source, n_tokens (over 0), n_docs.

    A source's tokens grow with ``b``, so its root lies between two bounds that each iteration moves; the middle is taken where Newton's step leaves them or gains little.
    """
    spark = lengths.sparkSession
    n, docs = F.col("n_tokens").cast("double"), F.col("n_docs")
    known = lengths.groupBy("source").agg(F.sum(docs).alias("docs"), F.sum(docs * n).alias("tokens"), F.sum(docs * n * n).alias("squares"), F.min(n).alias("least"), F.max(n).alias("most")).collect()
    known = {r["source"]: r for r in known if r["source"] in plan}
    mean = {s: r["tokens"] / r["docs"] for s, r in known.items()}
    low, high, at, last, done = {}, {}, {}, dict.fromkeys(known, float("inf")), {}
    for s, r in known.items():
        grow, cap = float(np.log(plan[s] / r["tokens"])), caps.get(s)
        even = grow * mean[s] * r["tokens"] / r["squares"]  # without a cap, the root isn't above this (Jensen)
        ends = grow * mean[s] / r["least"], grow * mean[s] / r["most"]
        full = None if cap is None else float(np.log(cap)) * mean[s] / r["least"]  # all are at the cap
        low[s], high[s] = min(ends), max(ends) if grow <= 0 or full is None else full
        if full is not None and plan[s] >= cap * r["tokens"] * (1 - 1e-12):
            done[s] = full
        else:
            at[s] = min(even, high[s])
    for _ in range(MAX_STEPS):
        if not at:
            break
        table = spark.createDataFrame([(s, float(b), float(mean[s]), caps.get(s)) for s, b in at.items()], "source string, b double, m double, cap long")
        x = n / F.col("m")
        rate = tilted_rate(F.col("b"), x, F.col("cap"))
        below = F.col("cap").isNull() | (rate < F.col("cap"))
        sums = lengths.join(F.broadcast(table), "source").groupBy("source").agg(F.sum(docs * x * rate).alias("w1"), F.sum(F.when(below, docs * x * x * rate).otherwise(0.0)).alias("w2")).collect()
        for r in sums:
            s, b = r["source"], at[r["source"]]
            want = plan[s] / mean[s]
            miss = abs(r["w1"] - want) / want
            if miss < TOLERANCE:
                done[s] = at.pop(s)
                continue
            low[s], high[s] = (b, high[s]) if r["w1"] < want else (low[s], b)
            # the logarithm of the tokens is nearly straight in b
            step = b - np.log(r["w1"] / want) * r["w1"] / r["w2"] if r["w1"] > 0 and r["w2"] > 0 else float("nan")
            at[s] = float(step) if low[s] < step < high[s] and miss < last[s] / 2 else (low[s] + high[s]) / 2
            last[s] = miss
    if at:
        raise ArithmeticError(f"no balance within {MAX_STEPS} steps for {sorted(at)}")
    return {s: (b, mean[s]) for s, b in done.items()}


def mix_sources(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, path: str = DEFAULT_TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """The chosen documents (``doc_id``, ``source``, ``n_tokens``, ``repeats``) and the report, a row for each source of either table.

    Report: ``source``, ``target_share``, ``max_repeats``, ``n_docs``, ``n_tokens`` (as filed), ``docs_chosen``, ``tokens_chosen``, ``actual_share``, ``part_used``
    (tokens chosen, repeats counted, over the source's tokens) and ``binds`` (whether the source gives all its cap permits, and so bounds a mix without ``total_tokens``). Sources are compared without case and
    outer blanks; documents of null or unlisted sources are not drawn (a null source is reported as null). Texts without tokens are not drawn. A null
    ``max_repeats`` is no bound; 0 draws nothing. The same text filed under two ids is two documents. Empty tables give empty results.
    """
    sized = count_tokens(documents.select("doc_id", "text", source_name(F.col("source")).alias("source")), "text", ["doc_id", "source"], "n_tokens", path)
    sized = materialize(sized, "document-sizes")
    wanted = read_targets(targets)
    lengths = materialize(sized.groupBy("source", "n_tokens").agg(F.count("*").alias("n_docs")), "document-lengths")
    listed = lengths.filter(F.col("source").isin(list(wanted))) if wanted else lengths.limit(0)
    sizes = {r["source"]: int(r["n"]) for r in listed.groupBy("source").agg(F.sum(F.col("n_docs") * F.col("n_tokens")).alias("n")).collect()}
    plan = planned_tokens(sizes, wanted, total_tokens)
    rates = balance(listed.filter("n_tokens > 0"), plan, {s: t.cap for s, t in wanted.items()}) if plan else {}

    spark = documents.sparkSession
    schema = "source string, b double, m double, cap long, plan double"
    table = spark.createDataFrame([(s, float(b), float(m), wanted[s].cap, float(plan[s])) for s, (b, m) in rates.items()], schema)
    rate = tilted_rate(F.col("b"), F.col("n_tokens") / F.col("m"), F.col("cap"))
    # a rate that the last digits put off a whole number is that number
    rate = F.when((F.round(rate) > 0) & (F.abs(rate - F.round(rate)) < 1e-9), F.round(rate)).otherwise(rate)
    drawn = sized.filter("n_tokens > 0").join(F.broadcast(table), "source").withColumn("_rate", rate)
    hashed = (F.shiftrightunsigned(F.xxhash64("source", "doc_id", "n_tokens"), 11) + 1) / F.lit(2.0**53)
    drawn = drawn.withColumn("_whole", F.floor("_rate")).withColumn("_part", F.col("_rate") - F.col("_whole"))
    # without a part of a copy left the order is null, and no further copy is taken
    drawn = drawn.withColumn("_order", F.when(F.col("_part") > 0, hashed / F.col("_part")))
    drawn = drawn.withColumn("_bucket", F.coalesce(F.floor(F.col("_order") / (1 + F.col("_order")) * BUCKETS), F.lit(BUCKETS)))
    may = F.col("_order").isNotNull()
    # tokens of whole copies, and how far down the hashed order the further copies go: sums per bucket first, then one bucket document by document
    per_bucket = drawn.groupBy("source", "_bucket").agg(F.sum(F.col("n_tokens") * F.col("_whole")).alias("_base"), F.sum(F.when(may, F.col("n_tokens")).otherwise(0)).alias("_more"), F.first("plan").alias("_plan"))
    per_bucket = materialize(per_bucket, "hash-buckets")
    w = Window.partitionBy("source").orderBy("_bucket")
    per_bucket = per_bucket.select("source", "_bucket", (F.col("_plan") - F.sum("_base").over(Window.partitionBy("source"))).alias("_lack"), F.sum("_more").over(w).alias("_upto"), "_more")
    edge = per_bucket.filter("_upto > _lack").groupBy("source").agg(F.min(F.struct("_bucket", "_lack", (F.col("_upto") - F.col("_more")).alias("_before"))).alias("_edge")).select("source", F.col("_edge._bucket").alias("_edge_bucket"), (F.col("_edge._lack") - F.col("_edge._before")).alias("_left"))
    with_edge = drawn.join(F.broadcast(edge), "source", "left")  # a row for each target source
    order = Window.partitionBy("source").orderBy("_order", "doc_id")
    at_edge = with_edge.filter(F.col("_bucket") == F.col("_edge_bucket"))
    upto = F.sum(F.when(may, F.col("n_tokens")).otherwise(0)).over(order)
    at_edge = at_edge.withColumn("_fits", may & (upto <= F.col("_left")))
    others = with_edge.filter(F.col("_edge_bucket").isNull() | (F.col("_bucket") != F.col("_edge_bucket")))
    others = others.withColumn("_fits", may & (F.col("_edge_bucket").isNull() | (F.col("_bucket") < F.col("_edge_bucket"))))
    # what the copies up to the mark leave open goes to the one document further down that comes nearest to it
    gap = at_edge.groupBy("source").agg((F.max("_left") - F.sum(F.when(F.col("_fits"), F.col("n_tokens")).otherwise(0))).alias("_gap"))
    both = others.unionByName(at_edge)
    off = F.abs(F.col("n_tokens") - F.col("_gap"))
    last = both.filter(may & ~F.col("_fits")).join(F.broadcast(gap), "source").filter(off < F.col("_gap")).groupBy("source").agg(F.min(F.struct(off, "_order", "doc_id")).alias("_last"))
    both = both.join(F.broadcast(last.select("source", F.col("_last.doc_id").alias("_last_id"))), "source", "left")
    both = both.withColumn("_extra", F.when(F.col("_fits") | (may & (F.col("doc_id") == F.col("_last_id"))), 1).otherwise(0))
    chosen = both.withColumn("repeats", (F.col("_whole") + F.col("_extra")).cast("int"))
    chosen = chosen.filter("repeats > 0").select("doc_id", "source", "n_tokens", "repeats")
    chosen = materialize(chosen, "mix")

    binding = [s for s, n in plan.items() if wanted[s].cap is not None and n >= wanted[s].cap * sizes[s] * (1 - 1e-12)]
    goals = spark.createDataFrame([(s, float(t.share), t.cap) for s, t in wanted.items()], "source string, target_share double, max_repeats long")
    have = lengths.groupBy("source").agg(F.sum("n_docs").alias("n_docs"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("n_tokens"))
    took = chosen.groupBy("source").agg(F.count("*").alias("docs_chosen"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens_chosen"))
    report = have.join(goals, "source", "full").join(took, "source", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    whole = took.agg(F.sum("tokens_chosen").alias("_all"))
    report = report.crossJoin(F.broadcast(whole)).select(  # one row
        "source", zero("target_share").alias("target_share"), "max_repeats", zero("n_docs").alias("n_docs"), zero("n_tokens").alias("n_tokens"),
        zero("docs_chosen").alias("docs_chosen"), zero("tokens_chosen").alias("tokens_chosen"), F.coalesce(F.col("tokens_chosen") / F.col("_all"), F.lit(0.0)).alias("actual_share"),
        F.coalesce(F.col("tokens_chosen") / F.when(F.col("n_tokens") > 0, F.col("n_tokens")), F.lit(0.0)).alias("part_used"), F.coalesce(F.col("source").isin(binding), F.lit(False)).alias("binds"),
    )
    return chosen, report
