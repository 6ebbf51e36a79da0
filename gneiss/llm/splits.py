"""Splits that keep related samples together: components, then component swap search.

Samples are related by family, repository and duplicate group, directly or
through others. The relation is contracted to a graph of families and
repositories (a duplicate group adds edges only if it joins several of them),
whose components are found by core's star rounds. Whole components then go to
splits, the largest first: those that hold at least 1/HEAVY of all samples (so
at most HEAVY of them, whatever the corpus) share one block, the others are cut
by hash into blocks of about BLOCK components, which fill what the first left.
In each block CHAINS annealing chains run in parallel: they start from the
hashed assignment and move or swap whole components, TRIES times a component, so
that sizes and label mix come closer to the target, sizes first; the best chain
is kept.

Defined cases: missing values and placeholders relate nothing; a sample with
none of the three keys is a component of its own; repeated rows of a sample
count once and get one split; null sample_ids are left out; an empty table gives
an empty result; labels beyond the LABELS most frequent count as one label;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.operators.components import connected_components
from gneiss.storage import Scratch

PROPORTIONS = {"train": 0.8, "validation": 0.1, "test": 0.1}
HEAVY = 2000
BLOCK = 4_000
CHAINS = 4
TRIES = 8
LEAST_TRIES = 2_000  # a block of few components is searched for at least so many steps
LABELS = 64
LABEL_WEIGHT = 0.1  # of the label mix in the cost, against 1 for the sizes

# Spellings that stand for a missing key.
PLACEHOLDERS = ["", "unknown", "n/a", "na", "none", "null", "nil", "-", "--", "?", "tbd", "todo", "undefined", "missing", "nan", "default"]


def present(c: Column) -> Column:
    """Lower-case trimmed key; null for placeholders and for one character repeated (such as a hash of zeros)."""
    plain = F.lower(F.trim(c))
    return F.when(~plain.isin(PLACEHOLDERS) & ~plain.rlike(r"^(.)\1{3,}$"), plain)


def family_name(c: Column) -> Column:
    """owner/name in lower case, without scheme, user, host, .git, blanks and slashes around; null if missing."""
    plain = F.regexp_replace(present(c), r"^([a-z+]+://)?([^@/\s]+@)?", "")
    plain = F.regexp_replace(F.regexp_replace(plain, ":", "/"), r"(/|\s|\.git)+$", "")
    parts = F.filter(F.transform(F.split(plain, "/"), F.trim), lambda x: x != "")
    return present(F.concat_ws("/", F.slice(parts, F.greatest(F.lit(1), F.size(parts) - 1), 2)))


def keyed(samples: DataFrame, *more: Column) -> DataFrame:
    """(sample_id, family, repo, dup, more, anchor): the keys that relate, and the node that stands for the sample."""
    k = samples.where("sample_id IS NOT NULL").select(
        "sample_id",
        family_name(F.col("repo_family")).alias("family"),
        present(F.col("repo_id")).alias("repo"),
        present(F.col("duplicate_group")).alias("dup"),
        *more,
    )
    return k.withColumn(
        "anchor",
        F.coalesce(F.concat(F.lit("f:"), "family"), F.concat(F.lit("r:"), "repo"), F.concat(F.lit("d:"), "dup"), F.concat(F.lit("s:"), "sample_id")),
    )


def relations(keys: DataFrame) -> DataFrame:
    """Distinct edges (u, v) between the nodes of related samples; a duplicate group is a star, never all its pairs."""
    direct = keys.where("family IS NOT NULL AND repo IS NOT NULL").select(F.col("anchor").alias("u"), F.concat(F.lit("r:"), "repo").alias("v"))
    groups = keys.where("dup IS NOT NULL").select("dup", "anchor").distinct()
    centre = groups.groupBy("dup").agg(F.min("anchor").alias("v"), F.max("anchor").alias("w")).where("v < w").select("dup", "v")
    through = groups.join(centre, "dup").where("anchor <> v").select(F.col("anchor").alias("u"), "v")
    return direct.unionByName(through).distinct()


def written_keys(scratch: Scratch, samples: DataFrame, label: str = "code_language") -> DataFrame:
    """keyed() with the label (null is one), written: the samples are read once, and what follows has a small plan."""
    return scratch.keep(keyed(samples, F.coalesce(F.lower(F.trim(label)), F.lit("")).alias("label")))


def family_pairs(samples: DataFrame) -> DataFrame:
    """(family_a, family_b): pairs of different families that share a component, and so a split, of the assignment.

    As many rows as pairs; family_components() has one row a family.
    """
    fam = Scratch(samples.sparkSession, "pairs").keep(family_components(samples).select("component", "split", "family"))
    a = fam.withColumnRenamed("family", "family_a")
    b = fam.withColumnRenamed("family", "family_b")
    return a.join(b, ["component", "split"]).where("family_a < family_b").select("family_a", "family_b")


def family_components(samples: DataFrame) -> DataFrame:
    """(family, component, split, n_samples) of every family by the assignment: one row a family, as it is never divided."""
    scratch = Scratch(samples.sparkSession, "splits")
    keys = written_keys(scratch, samples)
    assigned = _assign(scratch, keys)
    named = keys.where("family IS NOT NULL").select("sample_id", "family").distinct()
    return named.join(assigned, "sample_id").groupBy("family", "component", "split").agg(F.count(F.lit(1)).alias("n_samples"))


Labels = list[list[tuple[int, float]]]  # of each component, (label, samples)


def _anneal(size: list[float], labels: Labels, target: list[float], mix: np.ndarray, start: list[int], seed: int, steps: int) -> tuple[list[int], float]:
    """One chain: the best assignment seen and its cost.

    target: samples wanted in each split; mix: samples by split and label
    wanted. Cost: squared deviations, each by its target, labels by their weight
    in all.
    """
    rng = np.random.default_rng(seed)
    n, k = len(size), len(target)
    by_size = [1.0 / max(t, 1.0) for t in target]
    by_label = (LABEL_WEIGHT / max(mix.shape[1], 1) / np.maximum(mix, 1.0)).tolist()
    dev, dev_m = [-t for t in target], (-mix).tolist()
    where = list(start)
    for i, s in enumerate(where):
        dev[s] += size[i]
        for x, c in labels[i]:
            dev_m[s][x] += c

    def move(i: int, s: int, t: int) -> float:
        """Move component i from s to t; the change of the cost."""
        c = size[i]
        change = by_size[s] * c * (c - 2 * dev[s]) + by_size[t] * c * (c + 2 * dev[t])
        dev[s] -= c
        dev[t] += c
        ms, mt, ws, wt = dev_m[s], dev_m[t], by_label[s], by_label[t]
        for x, c in labels[i]:
            change += ws[x] * c * (c - 2 * ms[x]) + wt[x] * c * (c + 2 * mt[x])
            ms[x] -= c
            mt[x] += c
        where[i] = t
        return change

    cost = sum(d * d * w for d, w in zip(dev, by_size)) + sum(d * d * w for ds, ws in zip(dev_m, by_label) for d, w in zip(ds, ws))
    best, best_cost = list(where), cost
    heat = max(cost / 10, 1e-9)
    picks, other, to, luck = rng.integers(0, n, steps).tolist(), rng.integers(0, n, steps).tolist(), rng.integers(0, k, steps).tolist(), rng.random(steps).tolist()
    since = []  # moves since the best, to go back to it without copying it each time
    for i in range(steps):
        a, b = picks[i], other[i]
        s = where[a]
        swap = i % 2 and where[b] != s
        t = where[b] if swap else to[i]
        if s == t:
            continue
        change = move(a, s, t) + (move(b, t, s) if swap else 0.0)
        if change <= 0 or luck[i] < np.exp(-change / max(heat * (1 - i / steps) ** 2, 1e-12)):
            cost += change
            since.append((a, t))
            if swap:
                since.append((b, s))
            if cost < best_cost - 1e-9:
                for c, at in since:
                    best[c] = at
                best_cost, since = cost, []
        else:
            if swap:
                move(b, s, t)
            move(a, t, s)
    return best, best_cost


def _place(pdf: pd.DataFrame, target: np.ndarray, mix: np.ndarray, labels: list[str], seed: int) -> tuple[list[int], float]:
    at = {x: i for i, x in enumerate(labels)}
    found = [[(at[x], float(c)) for x, c in dict(m).items()] for m in pdf["labels"]]
    bounds = np.cumsum(target / target.sum())
    start = np.minimum(np.searchsorted(bounds, pdf["h"].to_numpy(float), side="right"), len(target) - 1)
    return _anneal(pdf["n"].astype(float).tolist(), found, target.tolist(), mix, start.tolist(), seed, max(LEAST_TRIES, TRIES * len(pdf)))


def assign_splits(
    samples: DataFrame, proportions: dict[str, float] | None = None, label: str = "code_language", seed: int = 17
) -> DataFrame:
    """(sample_id, component, split): one row a sample; a component is never divided.

    label: column whose mix is balanced over the splits (null is a label).
    """
    scratch = Scratch(samples.sparkSession, "splits")
    return _assign(scratch, written_keys(scratch, samples, label), proportions, seed)


def _assign(scratch: Scratch, keys: DataFrame, proportions: dict[str, float] | None = None, seed: int = 17) -> DataFrame:
    """assign_splits() from the written keys."""
    spark = scratch.spark
    wanted = proportions or PROPORTIONS
    names, share = list(wanted), np.array(list(wanted.values()), float)
    share = share / share.sum()
    found = connected_components(relations(keys))  # nodes without any edge are not in it
    own = keys.groupBy("sample_id").agg(F.min("anchor").alias("anchor"), F.min("label").alias("label"))
    members = scratch.keep(
        own.join(found, F.col("anchor") == F.col("node"), "left").select("sample_id", F.coalesce("component", "anchor").alias("component"), "label")
    )
    common = members.groupBy("label").agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "label").limit(LABELS).select("label")
    rest = F.lit("\0rest")
    per = (
        members.join(F.broadcast(common.withColumn("known", F.lit(True))), "label", "left")
        .groupBy("component", F.when(F.col("known"), F.col("label")).otherwise(rest).alias("label")).agg(F.count(F.lit(1)).alias("c"))
    )
    comps = scratch.keep(
        per.groupBy("component").agg(F.sum("c").alias("n"), F.map_from_entries(F.collect_list(F.struct("label", "c"))).alias("labels"))
        .withColumn("h", F.pmod(F.xxhash64("component", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30)))
    )
    total, count = comps.agg(F.sum("n"), F.count(F.lit(1))).first()
    if not count:
        return members.select("sample_id", "component", F.lit(None).cast("string").alias("split"))
    mixed = comps.select(F.explode("labels").alias("label", "c")).groupBy("label").agg(F.sum("c").alias("c")).orderBy("label").collect()  # at most LABELS + 1
    labels, by_label = [r[0] for r in mixed], np.array([r[1] for r in mixed], float)

    big = F.col("n") * HEAVY >= total
    heavy = comps.where(big).orderBy("component").toPandas()  # at most HEAVY rows, as each has 1/HEAVY of all samples or more
    heavy_where: list[int] = []
    used, used_mix = np.zeros(len(names)), np.zeros((len(names), len(labels)))
    if len(heavy):
        rows = spark.createDataFrame([(i,) for i in range(CHAINS)], "chain int").repartition(CHAINS, "chain")
        part = float(heavy["n"].sum()) / total

        def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for c in b["chain"]:
                    got, cost = _place(heavy, share * total * part, np.outer(share, by_label) * part, labels, seed + int(c))
                    yield pd.DataFrame({"chain": [c], "cost": [cost], "where": [got]})

        runs = rows.mapInPandas(chain, "chain int, cost double, where array<int>")
        heavy_where = list(runs.orderBy("cost", "chain").first()["where"])
        np.add.at(used, heavy_where, heavy["n"].to_numpy(float))
        np.add.at(used_mix, heavy_where, np.array([[dict(m).get(x, 0) for x in labels] for m in heavy["labels"]], float).reshape(len(heavy), -1))
    left = np.maximum(share * total - used, 1e-6)
    left_mix = np.maximum(np.outer(share, by_label) - used_mix, 0)
    light_total = max(float(total - used.sum()), 1.0)
    blocks = max(1, -(-count // BLOCK))

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("component", ignore_index=True)
        part = float(pdf["n"].sum()) / light_total
        got, cost = _place(pdf, left / left.sum() * light_total * part, left_mix * part, labels, seed + int(pdf["chain"].iloc[0]))
        return pd.DataFrame({"block": pdf["block"], "chain": pdf["chain"], "cost": cost, "component": pdf["component"], "at": got})

    light = comps.where(~big).withColumn("block", F.pmod(F.xxhash64("component"), F.lit(blocks)).cast("int"))
    light = light.withColumn("chain", F.explode(F.array(*[F.lit(i) for i in range(CHAINS)])))
    runs = scratch.keep(
        light.groupBy("block", "chain").applyInPandas(block, "block int, chain int, cost double, component string, at int")
    )
    best = runs.groupBy("block").agg(F.min(F.struct("cost", "chain")).alias("b")).select("block", F.col("b.chain").alias("chain"))
    placed = runs.join(best, ["block", "chain"]).select("component", "at")
    if len(heavy):
        placed = placed.unionByName(
            spark.createDataFrame([(c, int(a)) for c, a in zip(heavy["component"], heavy_where)], "component string, at int")
        )
    split = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("at") + 1)
    return members.join(placed, "component").select("sample_id", "component", split.alias("split"))


def invariants(samples: DataFrame) -> DataFrame:
    """(n_samples, n_divided, balanced) of the assignment: samples, families or repositories in more than one split, and whether each
    split misses its share by no more than a hundredth of all samples or the largest component."""
    assigned = Scratch(samples.sparkSession, "invariants").keep(assign_splits(samples))
    named = keyed(samples).select("sample_id", F.explode(F.array(F.concat(F.lit("f:"), "family"), F.concat(F.lit("r:"), "repo"), F.concat(F.lit("d:"), "dup"))).alias("key")).dropna()
    divided = named.join(assigned, "sample_id").groupBy("key").agg(F.min("split").alias("a"), F.max("split").alias("b")).where("a < b")
    wanted = samples.sparkSession.createDataFrame(list(PROPORTIONS.items()), "split string, share double")
    total = assigned.agg(F.count(F.lit(1)).alias("n_samples"), F.countDistinct("sample_id").alias("n_distinct"))
    largest = assigned.groupBy("component").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("largest"))
    sizes = wanted.join(assigned.groupBy("split").agg(F.count(F.lit(1)).alias("n")), "split", "left").crossJoin(total).crossJoin(largest)
    off = F.abs(F.coalesce("n", F.lit(0)) - F.col("share") * F.col("n_samples"))
    fits = sizes.agg(F.bool_and(off <= F.greatest(F.col("n_samples") / 100, F.col("largest"))).alias("balanced"))
    bad = divided.agg(F.count(F.lit(1)).alias("n_divided"))
    return total.where("n_samples = n_distinct").crossJoin(bad).crossJoin(fits).select("n_samples", "n_divided", "balanced")


def split_sizes(assigned: DataFrame) -> DataFrame:
    """(split, n_samples, n_components) of an assignment."""
    return assigned.groupBy("split").agg(F.count(F.lit(1)).alias("n_samples"), F.countDistinct("component").alias("n_components"))
