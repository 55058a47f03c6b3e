"""Mixing sources to target weights by hierarchical budgeting.

Leaves are (domain, language, source). The token budget of a node is shared among its children in
proportion to their weights; a child can take at most ``max_epochs`` times the tokens below it, and
what it can't take goes to its siblings, and only what they all can't take to the parent's
siblings: each level is filled like water in vessels, with the capacities of whole subtrees. A leaf
with budget b and T tokens gets floor(b / T) whole epochs and, of the next epoch, the longest prefix
of its documents in that epoch's seeded order that fits into what remains.

Only (leaf, tokens) rows are grouped; the order's prefix sums run over ranges of the order first
and then within the one range of each leaf that the budget ends in (as many ranges as a range
holds documents, about), so no leaf is sorted whole. A
leaf's decision is one row (epochs, last order key), which selects documents without shuffling
their texts.

Defined results: null domain, language or source counts as ''; a document without words takes no
tokens and comes with every epoch its place in the order allows; rows with equal order keys (equal
or null doc_ids in one leaf) stay or go together; a weight of 0 or less gives no budget; an empty
table gives an empty result; further columns pass through, and ones named like result columns are
replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm import textkit as K

LEVELS = ["domain", "lang", "source"]
BUDGET_SHARE = 0.6
MAX_EPOCHS = 2
SEED = 11
# Target weights by language; every other node weighs 1 among its siblings.
LANGUAGE_WEIGHTS = {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 2.0}


def source_family(source: Column) -> Column:
    """Default domain: the source's name without its last digits' tens (its last character)."""
    return F.concat(F.lit("family-"), F.substring(F.coalesce(source, F.lit("")), -1, 1))


def _order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def _range(key: Column, ranges: Column) -> Column:
    """Number of the key's range when the order is cut into ``ranges`` equal ones."""
    return F.floor(F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32)) * ranges).cast("long")


def budgets(leaves: DataFrame, budget: Column, weight_of, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``leaves`` (LEVELS, tokens, ...) with ``budget``: whole tokens for each leaf."""
    d = leaves.withColumn("share", budget.cast("double"))
    for depth, level in enumerate(LEVELS):
        above, here = LEVELS[:depth], LEVELS[: depth + 1]
        node = d.groupBy(*here).agg((F.sum("tokens") * max_epochs).cast("double").alias("room"), F.max("share").alias("total"))
        node = node.withColumn("weight", weight_of(level)).where("weight > 0")
        order = Window.partitionBy(*above).orderBy(F.col("room") / F.col("weight"), level)
        before = F.coalesce(F.sum("room").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        beyond = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
        node = node.withColumn("line", (F.col("total") - before) / beyond)
        node = node.withColumn("line", F.max("line").over(Window.partitionBy(*above)))
        node = node.select(*here, F.least("room", F.greatest(F.lit(0.0), F.col("line") * F.col("weight"))).alias("share"))
        d = d.drop("share").join(node, here)
    return d.withColumn("budget", F.floor(F.col("share") + 1e-6).cast("long")).drop("share")


def language_weight(level: str) -> Column:
    if level != "lang":
        return F.lit(1.0)
    out = F.lit(1.0)
    for lang, w in LANGUAGE_WEIGHTS.items():
        out = F.when(F.col("lang") == lang, w).otherwise(out)
    return out


def mix(docs: DataFrame, domain: Column | None = None, budget_share: float = BUDGET_SHARE, weight_of=language_weight,
        max_epochs: int = MAX_EPOCHS, seed: int = SEED, text_col: str = "text") -> DataFrame:
    """The selected rows of ``docs``, once per epoch, with domain, n_tokens (words) and epoch."""
    made = ["domain", "n_tokens", "epoch"]
    own = K.named([c for c in docs.columns if c not in made])
    domain = source_family(F.col("source")) if domain is None else domain
    words = F.size(F.regexp_extract_all(F.coalesce(text_col, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    leaf = [F.coalesce(c, F.lit("")).alias(f"__{n}") for n, c in zip(LEVELS, (domain, F.col("lang"), F.col("source")))]
    rows = docs.select(*own, *leaf, words.cast("long").alias("n_tokens"))
    keys = [f"__{n}" for n in LEVELS]

    thin = K.written(rows.select("doc_id", *(F.col(f"__{n}").alias(n) for n in LEVELS), "n_tokens"))
    leaves = thin.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_docs"))
    total = thin.agg(F.floor(F.coalesce(F.sum("n_tokens"), F.lit(0)) * budget_share)).first()[0]
    leaves = budgets(leaves, F.lit(total), weight_of, max_epochs)
    leaves = leaves.select(
        *LEVELS, F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0).cast("int").alias("epochs"),
        F.when(F.col("tokens") > 0, F.col("budget") % F.col("tokens")).otherwise(0).alias("rest"),
        F.ceil(F.sqrt("n_docs")).cast("double").alias("ranges"))
    leaves = K.written(leaves)

    at = thin.join(leaves, LEVELS).withColumn("key", _order_key(seed, F.col("epochs"), F.col("doc_id")))
    at = at.withColumn("range", _range(F.col("key"), F.col("ranges")))
    sums = at.groupBy(*LEVELS, "range", "rest").agg(F.sum("n_tokens").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*LEVELS).orderBy("range"))
    sums = sums.withColumn("before", upto - F.col("n"))
    # the range that the budget ends in: the last one that begins within it
    last = sums.where("before <= rest").groupBy(*LEVELS).agg(F.max(F.struct("range", "before")).alias("end"))
    last = last.select(*LEVELS, F.col("end.range").alias("range"), F.col("end.before").alias("before"))
    inside = at.join(last, [*LEVELS, "range"])
    run = F.sum("n_tokens").over(Window.partitionBy(*LEVELS).orderBy("key")) + F.col("before")
    cut = inside.withColumn("run", run).where("run <= rest").groupBy(*LEVELS).agg(F.max("key").alias("last_key"))
    plan = leaves.join(last, LEVELS, "left").join(cut, LEVELS, "left").select(
        *(F.col(n).alias(k) for n, k in zip(LEVELS, keys)), "epochs", "ranges", F.col("range").alias("end_range"), "last_key")
    plan = K.written(plan)

    key = _order_key(seed, F.col("epochs"), F.col("doc_id"))
    chosen = rows.join(plan, keys).withColumn("__key", key)
    place = _range(F.col("__key"), F.col("ranges"))
    partly = (place < F.col("end_range")) | ((place == F.col("end_range")) & (F.col("__key") <= F.col("last_key")))
    copies = F.col("epochs") + F.when(partly & (F.col("epochs") < max_epochs), 1).otherwise(0)
    chosen = chosen.withColumn("__copies", copies).where("__copies > 0")
    return chosen.select(*own, F.col("__domain").alias("domain"), "n_tokens",
                         F.explode(F.sequence(F.lit(0), F.col("__copies") - 1)).alias("epoch"))


def digest(mixed: DataFrame) -> DataFrame:
    return mixed.select("doc_id", "domain", "lang", "source", "n_tokens", "epoch")


_LANG = " ".join(f"WHEN '{k}' THEN {v}" for k, v in LANGUAGE_WEIGHTS.items())


def _level(name: str, above: list[str], level: str, weight: str, source: str) -> str:
    here = ", ".join([*above, level])
    part = f"PARTITION BY {', '.join(above)}" if above else ""
    order = f"{part} ORDER BY room / w, {level}"
    return f"""
{name}_n AS (
  SELECT {here}, CAST(sum(tokens) * {MAX_EPOCHS} AS DOUBLE) AS room, max(share) AS total, CAST({weight} AS DOUBLE) AS w
  FROM {source} GROUP BY {here}),
{name}_l AS (
  SELECT *, (total - coalesce(sum(room) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS line FROM {name}_n),
{name}_s AS (SELECT {here}, least(room, greatest(0, max(line) OVER ({part}) * w)) AS s FROM {name}_l),
{name} AS (SELECT x.domain, x.lang, x.source, x.tokens, {name}_s.s AS share FROM {source} x JOIN {name}_s USING ({here}))"""


ORACLE = f"""
WITH d AS (
  SELECT doc_id, 'family-' || right(coalesce(source, ''), 1) AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens FROM documents),
l0 AS (
  SELECT domain, lang, source, sum(n_tokens) AS tokens,
         CAST((SELECT floor(sum(n_tokens) * {BUDGET_SHARE}) FROM d) AS DOUBLE) AS share FROM d GROUP BY ALL),
{_level('a', [], 'domain', '1', 'l0')},
{_level('b', ['domain'], 'lang', f'CASE lang {_LANG} ELSE 1 END', 'a')},
{_level('c', ['domain', 'lang'], 'source', '1', 'b')},
leaf AS (SELECT *, CAST(floor(share + 1e-6) AS BIGINT) AS b FROM c),
plan AS (
  SELECT domain, lang, source, CASE WHEN tokens > 0 THEN CAST(b // tokens AS INTEGER) ELSE 0 END AS epochs,
         CASE WHEN tokens > 0 THEN b % tokens ELSE 0 END AS rest FROM leaf),
o AS (
  SELECT d.*, epochs, rest, sum(n_tokens) OVER (
           PARTITION BY domain, lang, source
           ORDER BY md5('{SEED}:' || epochs || ':' || coalesce(CAST(doc_id AS VARCHAR), ''))) AS run
  FROM d JOIN plan USING (domain, lang, source)),
n AS (SELECT *, epochs + CASE WHEN run <= rest AND epochs < {MAX_EPOCHS} THEN 1 ELSE 0 END AS copies FROM o)
SELECT doc_id, domain, lang, source, n_tokens, CAST(unnest(range(copies)) AS INTEGER) AS epoch FROM n
"""
