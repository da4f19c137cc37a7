"""A mix of sources with target shares of the total size, by Pareto order sampling.

A source that is to give e copies of itself gives every document floor(e) whole copies for
certain. The rest is a sample of fixed size: a document with uniform random number u and
inclusion probability p has rank (u / (1 - u)) / (p / (1 - p)), and those of least rank are
taken. Inclusion probabilities of the rest differ from source to source, and inside a
source with the size of a document: p = f * (1 + (1 - f) * (m - s) / S) prefers small
documents to large ones, whose last copy may overshoot (f: fraction of a copy that is left;
s: the document's size; S: the largest; m: the mean size weighted by size). p lies between
0 and 1, and the expected sizes, the sums of p * s, add up to the rest. The sample ends where the sizes taken come nearest to the
rest. Random numbers are hashes of the document's id and the seed, so that lost tasks give the same mix.

The cut-off of a source is found by histograms of ranks, twice refined, and a running sum
over one bin alone, so that no task ever holds a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Bins of a histogram of ranks; the second splits a bin of the first.
BINS = 4096


def allocation(sizes: dict[str, int], targets: list[tuple[str, float, int]], total: int) -> dict[str, float]:
    """Size that each source is to give: its share of the total, at most max_repeats times its own size.

    What capped sources can't give is shared among the others in proportion to their
    shares, again and again until all is given or all are capped. Sources that are
    missing or empty give nothing.
    """
    cap = {s: float(sizes.get(s, 0) * max(0, int(r or 0))) for s, _, r in targets}
    share = {s: max(0.0, float(w or 0)) for s, w, _ in targets}
    out = dict.fromkeys(cap, 0.0)
    open_ = {s for s in cap if cap[s] > 0 and share[s] > 0}
    left = float(total)
    while open_ and left > 1e-9:
        weight = sum(share[s] for s in open_)
        over = {s for s in open_ if share[s] / weight * left >= cap[s]}
        if not over:
            for s in open_:
                out[s] = share[s] / weight * left
            break
        for s in over:
            out[s] = cap[s]
        left = total - sum(out.values())
        open_ -= over
    return out


def uniform(id_col: str, seed: int) -> Column:
    """A number strictly between 0 and 1 from the id and the seed."""
    return (F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def mix(sized: DataFrame, targets: DataFrame, id_col: str = "doc_id", source_col: str = "source", size_col: str = "n_tokens", seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """(copies, report): copies has id, source, size and `copies` (1 or more) of each document in the mix.

    Rows without id or source, and sources that aren't listed, are left out; documents of
    size 0 add nothing and are left out too. Duplicate ids count once. The report has one
    row a listed source: target_share, max_repeats, available, allotted, actual_size,
    actual_share, documents and copies.
    """
    wanted = [(r[source_col], r["target_share"], r["max_repeats"]) for r in targets.groupBy(source_col).agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).where(F.col(source_col).isNotNull()).orderBy(source_col).collect()]
    names = [s for s, _, _ in wanted]
    docs = sized.where(F.col(id_col).isNotNull() & F.col(source_col).isin(names) & (F.col(size_col) > 0)).select(id_col, source_col, F.col(size_col).cast("long").alias(size_col))
    docs = docs.groupBy(id_col).agg(F.max(F.struct(source_col, size_col)).alias("one")).select(id_col, "one.*")
    sums = {r[source_col]: (r["size"], r["largest"], r["squares"]) for r in docs.groupBy(source_col).agg(F.sum(size_col).alias("size"), F.max(size_col).alias("largest"), F.sum(F.col(size_col).cast("double") * F.col(size_col)).alias("squares")).collect()}
    total = sum(v[0] for v in sums.values())
    give = allocation({s: v[0] for s, v in sums.items()}, wanted, total)
    plan = {}
    for s in names:
        own, largest, squares = sums.get(s, (0, 1, 0.0))
        whole = int(give[s] // own) if own else 0
        rest = give[s] - whole * own
        plan[s] = (whole, rest, rest / own if own else 0.0, largest, squares / own if own else 0.0)

    def of(k: int) -> Column:
        """A value of the plan by source: a literal map over the listed sources."""
        if not plan:
            return F.lit(0.0)
        return F.create_map(*[F.lit(x) for s, v in plan.items() for x in (s, float(v[k]))])[F.col(source_col)]

    f = of(2)
    p = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), f * (1 + (1 - f) * (of(4) - F.col(size_col)) / of(3))))
    u = uniform(id_col, seed)
    odds = (u / (1 - u)) / (p / (1 - p))
    # the rank on a scale from 0 to 1 that keeps its order, for bins
    ranked = docs.withColumn("whole", of(0).cast("int")).withColumn("rest", of(1)).withColumn("rank", odds / (1 + odds))
    bin1 = F.floor(F.col("rank") * BINS)
    bin2 = F.floor((F.col("rank") * BINS - bin1) * BINS)
    ranked = ranked.withColumn("bin1", F.least(bin1, F.lit(BINS - 1)).cast("int")).withColumn("bin2", F.least(bin2, F.lit(BINS - 1)).cast("int"))

    # at most BINS rows a source come to the driver, for each of two levels
    def border(rows: list, before: dict[str, float]) -> dict[str, tuple[int, float]]:
        out: dict[str, tuple[int, float]] = {}
        run = dict(before)
        for r in rows:
            s = r[source_col]
            if s in out:
                continue
            if run[s] + r["n"] > plan[s][1]:
                out[s] = (r["bin"], run[s])
            else:
                run[s] += r["n"]
        for s in names:
            out.setdefault(s, (BINS, run[s]))
        return out

    first = border(ranked.groupBy(source_col, F.col("bin1").alias("bin")).agg(F.sum(size_col).alias("n")).orderBy(source_col, "bin").collect(), dict.fromkeys(names, 0.0))

    def bound(values: dict, k: int, kind: str) -> Column:
        return F.create_map(*[F.lit(x) for s in names for x in (s, values[s][k])])[F.col(source_col)].cast(kind) if names else F.lit(0).cast(kind)

    ranked = ranked.withColumn("b1", bound(first, 0, "int"))
    second = border(
        ranked.where("bin1 = b1").groupBy(source_col, F.col("bin2").alias("bin")).agg(F.sum(size_col).alias("n")).orderBy(source_col, "bin").collect(), {s: v[1] for s, v in first.items()}
    )
    ranked = ranked.withColumn("b2", bound(second, 0, "int"))
    below = F.expr("bin1 < b1 or (bin1 = b1 and bin2 < b2)")
    edge = ranked.where("bin1 = b1 and bin2 = b2")
    w = W.partitionBy(source_col).orderBy("rank", id_col)
    edge = edge.withColumn("upto", F.sum(size_col).over(w) + bound(second, 1, "double"))
    # the document that crosses the border is taken if that comes nearer
    edge = edge.where((F.col("upto") <= F.col("rest")) | (F.col("upto") - F.col("rest") < F.col("rest") - (F.col("upto") - F.col(size_col)))).select(id_col, F.lit(1).alias("at_edge"))
    chosen = ranked.join(edge, id_col, "left").withColumn("copies", F.col("whole") + F.when(below | F.col("at_edge").isNotNull(), 1).otherwise(0))
    copies = chosen.where("copies > 0").select(id_col, source_col, size_col, F.col("copies").cast("int").alias("copies"))
    got = copies.groupBy(source_col).agg(F.sum(F.col(size_col) * F.col("copies")).alias("actual_size"), F.count("*").alias("documents"), F.sum("copies").alias("copies"))
    spark = sized.sparkSession
    listed = spark.createDataFrame(
        [(s, float(t or 0), int(m or 0), int(sums.get(s, (0,))[0]), float(give[s])) for s, t, m in wanted], f"`{source_col}` string, target_share double, max_repeats int, available long, allotted double"
    )
    whole = W.partitionBy(F.lit(1))
    report = listed.join(got, source_col, "left").fillna(0, ["actual_size", "documents", "copies"])
    report = report.withColumn("actual_share", F.when(F.sum("actual_size").over(whole) > 0, F.col("actual_size") / F.sum("actual_size").over(whole)).otherwise(F.lit(0.0)))
    return copies, report
