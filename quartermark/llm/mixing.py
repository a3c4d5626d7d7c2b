"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Sources share the sum of all sizes by weight; a target stops at `max_epochs` times its source's size
and the excess is shared again, which has a closed form: with sources in the order of cap over
weight, the common level is the greatest of (total - caps before) / (weights from here on), and a
target is the lesser of level times weight and cap. A source first gives whole epochs. What remains
is filled with documents in ascending order of an exponential key, -ln(u) / quality, u hashed from
the seed and the id: the greater the quality, the earlier. Prefix sums of sizes run over range
partitions of (source, key), so a source that holds a third of all rows spans many tasks, and end in
one threshold per source. Applying the mix compares each row with its source's threshold where it
lies: texts are never shuffled.

A document without words or text has size 0 and costs nothing. Null sources are one source, last in
order. Null ids sort first among equal keys. Rows equal in key, id and size are taken or left
together. Extra columns pass through. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quartermark.llm.common import WORD
from quartermark.operators.windows import running_sums
from quartermark.session import cut

SYMBOL = r"[#*$%&|<>]"
SEED = 17


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def quality(text: str, size: Column) -> Column:
    """Quality weight in (0, 1]: falls with symbols per word."""
    symbols = F.coalesce(F.regexp_count(F.col(text), F.lit(SYMBOL)), F.lit(0))
    return 1.0 / (1.0 + symbols / F.greatest(size, F.lit(1)))


def exponential_key(id: str, weight: Column, seed: int = SEED) -> Column:
    """-ln(u) / weight with u in (0, 1) from the md5 of seed and id."""
    digest = F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(id).cast("string"), F.lit("")))), 1, 13)
    u = (F.conv(digest, 16, 10).cast("double") + 0.5) / float(1 << 52)
    return -F.log(u) / weight


def _sized(docs: DataFrame, id: str, text: str, source: str, seed: int) -> DataFrame:
    """doc_id, source, size and key of every row; the only pass over the texts."""
    base = docs.select(F.col(id).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text")).withColumn("size", word_count("text"))
    return base.select("doc_id", "source", "size", exponential_key("doc_id", quality("text", F.col("size")), seed).alias("key"))


def targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """source, source_size, target, epochs, rest: whole epochs and what a fraction of one must fill."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("last", F.col("source").isNull())
    placed = running_sums(sources, [], ["last", "source"], {"place": F.lit(1).cast("long")})
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int")).cast("long")
    capped = placed.withColumn("weight", weight).withColumn("cap", F.lit(max_epochs) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    running = cut(running_sums(capped, [], ["ratio", "place"], {"caps": F.col("cap"), "weights": F.col("weight"), "sizes": F.col("source_size")}))
    all_weights, total = [running.agg(F.max(c)).scalar() for c in ("weights", "sizes")]
    level = running.select(F.max((total - (F.col("caps") - F.col("cap"))) / (all_weights - (F.col("weights") - F.col("weight"))))).scalar()
    target = F.least(level * F.col("weight"), F.col("cap").cast("double"))
    epochs = F.when(F.col("source_size") > 0, F.floor(target / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    out = running.select("source", "source_size", target.alias("target"), epochs.alias("epochs"))
    return out.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))


def plan(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """`targets` with `upto`: the last (key, doc_id, size) of each source's fraction, null if empty.

    The document that crosses the budget is in if that ends nearer to it.
    """
    goal = cut(targets(sized, weights, max_epochs))
    keyed = sized.withColumns({"__null": F.col("source").isNull(), "__source": F.coalesce("source", F.lit(""))})
    running = running_sums(keyed, ["__null", "__source"], ["key", "doc_id", "size"], {"reach": F.col("size")})
    left = running.join(goal.select(F.col("source").alias("__s"), "rest"), F.col("source").eqNullSafe(F.col("__s")))
    before = F.col("reach") - F.col("size")
    inside = (F.col("reach") <= F.col("rest")) | ((before < F.col("rest")) & (F.col("reach") - F.col("rest") < F.col("rest") - before))
    last = left.filter(inside).groupBy(F.col("source").alias("__s")).agg(F.max(F.struct("key", "doc_id", "size")).alias("upto"))
    return cut(goal.join(last, F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s"))


def _times(mix: DataFrame, key: Column, id: Column, size: Column) -> Column:
    """How often the mix takes a row that was joined with its source's plan."""
    inside = F.struct(key.alias("key"), id.alias("doc_id"), size.alias("size")) <= mix["upto"]
    return mix["epochs"] + F.coalesce(inside, F.lit(False)).cast("long")


def mixture(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED) -> DataFrame:
    """Per row: doc_id, size, source_size, target, taken (words the mix takes), times."""
    sized = cut(_sized(docs, id, text, source, seed))
    mix = plan(sized).withColumnRenamed("source", "__s")
    joined = sized.join(mix, F.col("source").eqNullSafe(F.col("__s")))
    times = _times(mix, F.col("key"), F.col("doc_id"), F.col("size"))
    return joined.select("doc_id", "size", "source_size", "target", (times * F.col("size")).alias("taken"), times.alias("times"))


def mixed(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED) -> DataFrame:
    """Rows of `docs`, each as often as the mix takes it; all columns, nothing shuffled but sizes and keys."""
    mix = plan(cut(_sized(docs, id, text, source, seed)))
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names)
    at = {c: names[docs.columns.index(c)] for c in (id, text, source)}
    size = word_count(at[text])
    joined = rows.join(mix.withColumnRenamed("source", "__s"), F.col(at[source]).eqNullSafe(F.col("__s")))
    times = _times(mix, exponential_key(at[id], quality(at[text], size), seed), F.col(at[id]), size)
    return joined.withColumn("__n", F.explode(F.array_repeat(F.lit(1), times.cast("int")))).select(*names).toDF(*docs.columns)
