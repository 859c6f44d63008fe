"""Mixing sources to target weights: budgets down a domain-language-source tree, then token prefixes.

Budgets: the corpus budget is split among domains by weight, a domain's among its languages,
a language's among its sources. A node can use at most `max_epochs` times the tokens below it.
What a full node cannot use is raised as a common level over its siblings that are not full;
only what all of them cannot use is missing in their parent, whose own siblings then share it.
That is a water-filling of each group of siblings under the capacity of their subtrees, in
closed form: with siblings ordered by capacity per weight, the level is the least
(budget - capacity of the full ones) / (weight of the others) that fills no further one.
Weights are positive integers, so all sums are exact.

Selection: each epoch orders a leaf's documents by md5 of seed, epoch and doc_id. Whole epochs
are taken while the budget lasts; of the last one, the longest prefix whose tokens fit.

Scale: the texts are read twice, once to count tokens and once to select. Prefix sums never bring a leaf together. Tokens are summed per leaf, epoch and bucket
of the leading hash digits; the cut falls in one bucket of a leaf, and running sums are taken
in that bucket alone. The number of buckets grows with the corpus, so a bucket stays small.
The tree itself has one row per leaf; a family's level is found by sums over buckets of its
members, so no task orders all of them.

Edge cases: a null domain, language or source is a branch of its own; weights not listed are
1. A null or empty text has no tokens. Rows that
repeat a doc_id are ordered together and are in or out together; rows without a doc_id are
ordered by their text. Ties in the hash share one running sum. Empty tables give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brightwell.llm.common import fresh, materialize, read

BROADCAST_LEAVES = 20_000

TOKEN = r"[^ \t\r\n\f]+"


@dataclass(frozen=True)
class Mix:
    """A declared mixture. Domains name the sources that belong to them; weights are by level."""

    domains: dict[str, tuple[str, ...]]
    domain_weights: dict[str, int] = field(default_factory=dict)
    language_weights: dict[str, int] = field(default_factory=dict)
    source_weights: dict[str, int] = field(default_factory=dict)
    budget_share: float = 0.75  # of the tokens of the corpus
    max_epochs: int = 3
    seed: int = 17
    bucket_tokens: int = 20_000_000


PRODUCTION = Mix(
    domains={"web": tuple(f"src{i}" for i in range(8)), "forum": tuple(f"src{i}" for i in range(8, 14))},
    domain_weights={"web": 5, "forum": 3, "other": 2},
    language_weights={"en": 6, "de": 2, "fr": 2, "es": 2},
    source_weights={"src0": 4},
)
LEVELS = ("domain", "language", "source")


def _of(column: Column, known: dict[str, object], other: object) -> Column:
    """A lookup in a declared dict as one expression."""
    out = F.lit(other)
    for k, v in known.items():
        out = F.when(column == k, F.lit(v)).otherwise(out)
    return out


def _domain(mix: Mix, source: Column) -> Column:
    return reduce(lambda rest, kv: F.when(source.isin(*kv[1]), F.lit(kv[0])).otherwise(rest), mix.domains.items(), F.lit("other"))


OCTAVE = 64  # buckets of room / weight for each doubling


def _water(node: DataFrame, path: list[str]) -> DataFrame:
    """(path, water): the level to which the families' budgets fill their members; null where they fill all. node: path, room, weight, given.

    With members ordered by room / weight, the first whose share of what is left does not fill it sets the level. It is found in two steps: sums by bucket of that ratio tell in which bucket it lies, and only that bucket's ratios, equal ones as one, are put in order. Weights and rooms are whole numbers, so sums are exact in any order."""
    keys = path or ["_all"]
    by = lambda df: df if path else df.withColumn("_all", F.lit(0))
    ratio = F.col("room") / F.col("weight")
    bucket = F.when(ratio > 0, F.floor(F.log2(ratio) * OCTAVE)).otherwise(F.lit(-100_000)).cast("int")
    grouped = by(node).groupBy(*keys, bucket.alias("bucket"), ratio.alias("ratio")).agg(F.sum("room").alias("room"), F.sum("weight").alias("weight"), F.max("given").alias("given"))
    grouped = materialize(grouped, "mix-ratios")  # a plan that holds each level's plan several times would grow without measure
    sums = grouped.groupBy(*keys, "bucket").agg(F.sum("room").alias("room"), F.sum("weight").alias("weight"), F.max("given").alias("given"), F.max("ratio").alias("top"))
    ordered = Window.partitionBy(*keys).orderBy("bucket")
    before, onwards = ordered.rowsBetween(Window.unboundedPreceding, -1), ordered.rowsBetween(0, Window.unboundedFollowing)
    sums = sums.withColumns({"before": F.coalesce(F.sum("room").over(before), F.lit(0.0)), "rest": F.sum("weight").over(onwards)})
    # at the level of its largest ratio, a bucket and all before it are full
    sums = sums.withColumn("holds", F.col("before") + F.col("room") + F.col("top") * (F.col("rest") - F.col("weight")))
    at = sums.where(F.col("holds") >= F.col("given")).groupBy(*keys).agg(F.min_by(F.struct("bucket", "before", "rest"), "bucket").alias("at"))
    at = at.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("at.bucket").alias("in_bucket"), F.col("at.before").alias("before"), F.col("at.rest").alias("rest"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    inside = grouped.join(at, same & (F.col("bucket") == F.col("in_bucket")))
    within = Window.partitionBy(*keys).orderBy("ratio").rowsBetween(Window.unboundedPreceding, -1)
    full = lambda c: F.coalesce(F.sum(c).over(within), F.lit(0.0))
    share = (F.col("given") - F.col("before") - full("room")) / (F.col("rest") - full("weight"))
    # by rounding, the bucket's last ratio may seem just too low; then it is the level
    return inside.select(*keys, "ratio", share.alias("share")).groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("share") <= F.col("ratio"), F.col("share"))), F.max("ratio")).alias("water"))


def budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """leaves (domain, language, source, tokens) with the budget of each, by water-filling from the root."""
    weights = {"domain": mix.domain_weights, "language": mix.language_weights, "source": mix.source_weights}
    total = leaves.agg((F.lit(mix.budget_share) * F.sum("tokens")).alias("given"))
    tree = leaves.join(F.broadcast(total))  # one row
    for depth, level in enumerate(LEVELS):
        path = list(LEVELS[:depth])
        node = tree.groupBy(*path, level).agg((F.lit(mix.max_epochs) * F.sum("tokens")).cast("double").alias("room"), F.max("given").alias("given"))
        node = materialize(node.withColumn("weight", _of(F.col(level), weights[level], 1).cast("double")), "mix-nodes")
        water = _water(node, path)
        water = water.select(*(F.col(k).alias(f"_{k}") for k in path), "water")
        family = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in path]) if path else F.lit(True)
        node = node.join(water, family, "left") if path else node.join(F.broadcast(water.agg(F.max("water").alias("water"))))  # one row
        node = node.select(*path, level, F.least(F.col("room"), F.coalesce(F.col("water") * F.col("weight"), F.col("room"))).alias("granted"))
        keys = [*path, level]
        right = node.toDF(*(f"_{k}" for k in keys), "granted")
        on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
        tree = materialize(tree.join(right, on).drop(*(f"_{k}" for k in keys)).withColumn("given", F.col("granted")).drop("granted"), "mix-tree")
    return tree.withColumnRenamed("given", "budget")


def _leaf(docs: DataFrame, mix: Mix) -> list[Column]:
    return [_domain(mix, F.col("source")).alias("domain"), F.col("lang").alias("language"), F.col("source").alias("source")]


def _ident() -> Column:
    return F.coalesce(F.col("doc_id").cast("string"), F.md5("text"), F.lit(""))


def _place(mix: Mix, epoch: Column, ident: Column) -> Column:
    """Where an epoch puts a document: 32 hash digits in uniform order."""
    return F.md5(F.concat_ws(":", F.lit(str(mix.seed)), epoch.cast("string"), ident))


def _tokens(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(TOKEN)).cast("long")


def _same_leaf(a: str, b: str) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in LEVELS])


def cuts(docs: DataFrame, mix: Mix) -> DataFrame:
    """Per leaf its tokens, budget, whole epochs, and the last place that the next epoch's prefix takes (null: none)."""
    sized = materialize(docs.select(*_leaf(docs, mix), _ident().alias("ident"), _tokens(F.col("text")).alias("tokens")), "mix-sizes")
    leaves = materialize(sized.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens")), "mix-leaves")
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    digits = 1
    while total / 16**digits > mix.bucket_tokens:
        digits += 1
    plan = budgets(leaves, mix).withColumn("epochs", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.greatest("tokens", F.lit(1)))).otherwise(0).cast("int"))
    plan = materialize(plan.withColumn("left", F.col("budget") - F.col("epochs") * F.col("tokens")), "mix-plan")
    partial = plan.where(F.col("epochs") < mix.max_epochs).select(*LEVELS, "epochs", "left")
    placed = sized.alias("d").join(partial.alias("p"), _same_leaf("d", "p")).select(*(f"d.{k}" for k in LEVELS), "left", "tokens", _place(mix, F.col("epochs"), F.col("ident")).alias("place"))
    placed = placed.withColumn("bucket", F.substring("place", 1, digits))
    by_leaf = Window.partitionBy(*LEVELS)
    sums = placed.groupBy(*LEVELS, "bucket", "left").agg(F.sum("tokens").alias("tokens"))
    sums = sums.withColumn("upto", F.sum("tokens").over(by_leaf.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)))
    # the first bucket that does not fit as a whole; a leaf without one takes its last
    cut = sums.groupBy(*LEVELS).agg(F.min(F.when(F.col("upto") > F.col("left"), F.struct("bucket", (F.col("upto") - F.col("tokens")).alias("before")))).alias("at"), F.max("bucket").alias("last"))
    cut = materialize(cut.select(*LEVELS, "at.bucket", "at.before", "last"), "mix-cut")
    inside = placed.alias("d").join(cut.alias("c"), _same_leaf("d", "c") & (F.col("d.bucket") == F.col("c.bucket"))).select(*(f"d.{k}" for k in LEVELS), "place", "left", "tokens", "before")
    inside = inside.withColumn("upto", F.col("before") + F.sum("tokens").over(by_leaf.orderBy("place").rangeBetween(Window.unboundedPreceding, 0)))
    last = inside.where(F.col("upto") <= F.col("left")).groupBy(*LEVELS).agg(F.max("place").alias("place"))
    out = plan.alias("p").join(cut.alias("c"), _same_leaf("p", "c"), "left").join(last.alias("l"), _same_leaf("p", "l"), "left")
    # if nothing of the cut bucket fits, all that lies before that bucket is taken
    return out.select(*(F.col(f"p.{k}").alias(k) for k in LEVELS), "p.tokens", "budget", "epochs", F.coalesce(F.col("l.place"), F.col("c.bucket"), F.concat(F.col("c.last"), F.lit("g"))).alias("place"))


def mix_sources(docs: DataFrame, mix: Mix = PRODUCTION) -> DataFrame:
    """docs once for each epoch that selects them, with the epoch (from 0) as the last column."""
    plan = materialize(cuts(docs, mix), "mix-cuts")
    name = {k: fresh(docs, f"mix_{k}") for k in (*LEVELS, "tokens", "budget", "epochs", "place", "copies")}
    epoch = fresh(docs, "epoch")
    plan = plan.toDF(*(name[c] for c in plan.columns))
    if plan.count() <= BROADCAST_LEAVES:  # a row has six small fields
        plan = F.broadcast(plan)
    on = _domain(mix, F.col("source")).eqNullSafe(F.col(name["domain"])) & F.col("lang").eqNullSafe(F.col(name["language"])) & F.col("source").eqNullSafe(F.col(name["source"]))
    taken = F.coalesce((_place(mix, F.col(name["epochs"]), _ident()) <= F.col(name["place"])).cast("int"), F.lit(0))
    joined = docs.join(plan, on).withColumn(name["copies"], F.col(name["epochs"]) + taken).where(F.col(name["copies"]) > 0)
    return joined.select(*docs.columns, F.explode(F.sequence(F.lit(0), F.col(name["copies"]) - 1)).alias(epoch))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "source", F.coalesce("text", F.lit("")).alias("text"))
    mixed = mix_sources(docs)
    return mixed.select("doc_id", _domain(PRODUCTION, F.col("source")).alias("domain"), "lang", "source", _tokens(F.col("text")).alias("n_tokens"), "epoch")


def _case(column: str, known: dict[str, int]) -> str:
    return f"CASE {' '.join(f"WHEN {column} = '{k}' THEN {v}" for k, v in known.items())} ELSE 1 END" if known else "1"


def _sql(mix: Mix) -> str:
    domain = " ".join(f"WHEN source IN ({', '.join(f"'{x}'" for x in v)}) THEN '{k}'" for k, v in reversed(mix.domains.items()))
    out = [f"""WITH sized AS (SELECT doc_id, lang AS language, source, CASE {domain} ELSE 'other' END AS domain,
  coalesce(CAST(doc_id AS VARCHAR), md5(text), '') AS ident, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \t\r\n\f]+')) AS BIGINT) AS tokens FROM documents),
leaves AS (SELECT domain, language, source, CAST(sum(tokens) AS BIGINT) AS tokens FROM sized GROUP BY ALL),
t0 AS (SELECT *, CAST({mix.budget_share} AS DOUBLE) * CAST(sum(tokens) OVER () AS DOUBLE) AS given FROM leaves)"""]
    weights = (mix.domain_weights, mix.language_weights, mix.source_weights)
    for i, level in enumerate(LEVELS):
        path = list(LEVELS[:i])
        family = f"PARTITION BY {', '.join(path) or '0'}"
        keys = [*path, level]
        on = " AND ".join(f"t.{k} IS NOT DISTINCT FROM w.{k}" for k in keys)
        out.append(f"""n{i} AS (SELECT {', '.join(keys)}, CAST({mix.max_epochs} * sum(tokens) AS DOUBLE) AS room, any_value(given) AS given, CAST({_case(level, weights[i])} AS DOUBLE) AS weight FROM t{i} GROUP BY {', '.join(keys)}),
s{i} AS (SELECT *, (given - coalesce(sum(room) OVER ({family} ORDER BY room / weight NULLS FIRST, {level} NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER ({family} ORDER BY room / weight NULLS FIRST, {level} NULLS FIRST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share FROM n{i}),
w{i} AS (SELECT *, max(CASE WHEN share * weight <= room THEN share END) OVER ({family}) AS water FROM s{i}),
t{i + 1} AS (SELECT t.domain, t.language, t.source, t.tokens, least(w.room, coalesce(w.water * w.weight, w.room)) AS given FROM t{i} t JOIN w{i} w ON {on})""")
    out.append(f"""plan AS (SELECT *, CASE WHEN tokens > 0 THEN CAST(floor(given / greatest(tokens, 1)) AS INTEGER) ELSE 0 END AS epochs FROM t3),
placed AS (SELECT d.*, p.epochs, p.given - p.epochs * p.tokens AS room_left, md5(concat_ws(':', '{mix.seed}', CAST(p.epochs AS VARCHAR), d.ident)) AS place
  FROM sized d JOIN plan p ON d.domain IS NOT DISTINCT FROM p.domain AND d.language IS NOT DISTINCT FROM p.language AND d.source IS NOT DISTINCT FROM p.source),
ran AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, language, source ORDER BY place RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM placed),
copied AS (SELECT *, epochs + CASE WHEN epochs < {mix.max_epochs} AND upto <= room_left THEN 1 ELSE 0 END AS copies FROM ran)
SELECT doc_id, domain, language AS lang, source, tokens AS n_tokens, CAST(unnest(range(copies)) AS INTEGER) AS epoch FROM copied""")
    return ",\n".join(out)


OP1_SQL = _sql(PRODUCTION)
