"""Language-model scoring by cross-entropy difference.

Two character-trigram models of the same smoothing and vocabulary are counted: the target model from
the rows whose id is among the wanted ones, the background model from all rows. A document's score is
its mean loss under the background model minus its mean loss under the target model, per token: above
zero it is more like the target than like the corpus.

Tokens are code points, with two boundaries before a text and one after it. The vocabulary is every
code point of the corpus, in any script. A trigram's probability interpolates it with the bigram, that
with the code point's own share, and that with a uniform share over the vocabulary (Witten-Bell).

Counts are Spark tables that grow with the corpus: tasks add up the trigrams of their rows, Spark sums
them by trigram, and the losses of every trigram are one row of a table. The HOT commonest trigrams (a
bound that a histogram of counts proves before they are collected) are broadcast, so that most tokens
are scored where the text is; every other trigram is joined with the table. What is broadcast changes
the traffic, never a score. A trigram is three times 21 bits of one long, so no two share a cell.

Scores belong to texts: sums are kept per 64-bit hash of a text, where equal texts count together in
both the losses and the tokens, which leaves their mean as it is.

Null and empty texts are one token, the boundary after the boundaries. Documents without a label or with
a null id belong to the background only; repeated rows count as often as they occur, and all rows of
an id are wanted if it is. Without target documents the models are equal and every score is 0. Further
columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quartermark.llm.common import as_text, byte_slices, salted_left
from quartermark.session import cut

#: Trigrams that are broadcast, 24 bytes each.
HOT = 1 << 18
#: Bytes of text, or characters of one longer text, whose trigrams are made at a time.
CHUNK = 1 << 21
#: Bits of a token, and the boundary, which is no code point.
BITS, EDGE = 21, 0x110000


def grams(texts: list[str], limit: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, trigram that ends there) of every token, the last boundary included; a text beyond
    `limit` comes in parts."""
    short = [i for i, t in enumerate(texts) if len(t) <= limit]
    if short:
        sizes = np.fromiter((len(texts[i]) for i in short), np.int64, len(short))
        codes = np.full(int(sizes.sum()) + 3 * len(short), EDGE, np.int64)
        codes[np.arange(sizes.sum()) + np.repeat(np.arange(len(short)) * 3 + 2, sizes)] = points("".join(texts[i] for i in short))
        number = np.arange(len(short))
        at = np.arange(int(sizes.sum()) + len(short)) + np.repeat(2 * number, sizes + 1)
        yield np.repeat(np.array(short), sizes + 1), packed(codes)[at]
    for i, t in enumerate(texts):
        if len(t) > limit:
            last = np.full(2, EDGE, np.int64)
            for a in range(0, len(t), limit):
                codes = np.concatenate([last, points(t[a : a + limit]), np.full(int(a + limit >= len(t)), EDGE, np.int64)])
                last = codes[-2:]
                yield np.full(len(codes) - 2, i), packed(codes)


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), "<u4").astype(np.int64)


def packed(codes: np.ndarray) -> np.ndarray:
    return codes[:-2] << 2 * BITS | codes[1:-1] << BITS | codes[2:]


def counts(texts: DataFrame) -> DataFrame:
    """gram, n: trigrams of the one text column of `texts`, added up per part of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_slices(batches, 0, CHUNK):
            for _, found in grams(as_text(b.column(0))):
                gram, n = np.unique(found, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(n)], ["gram", "n"])

    return texts.mapInArrow(run, "gram long, n long")


def models(own: DataFrame, wanted: DataFrame) -> DataFrame:
    """gram, n, back, want: every trigram's count and its loss in nats under both models. Columns of `own`: doc_id, text."""
    none = F.lit(0).cast("long")
    every = counts(own.select("text")).select("gram", F.col("n").alias("a"), none.alias("t"))
    target = counts(own.join(wanted, F.col("doc_id") == F.col("__id"), "left_semi").select("text")).select("gram", none.alias("a"), F.col("n").alias("t"))
    added = [F.sum("a").alias("a"), F.sum("t").alias("t")]
    table = cut(every.unionByName(target).groupBy("gram").agg(*added))
    pairs = cut(table.groupBy(F.col("gram").bitwiseAND(F.lit((1 << 2 * BITS) - 1)).alias("gram")).agg(*added))
    singles = cut(pairs.groupBy(F.col("gram").bitwiseAND(F.lit((1 << BITS) - 1)).alias("gram")).agg(*added))
    size = singles.agg(F.sum("a").alias("a"), F.sum("t").alias("t"), F.count(F.lit(1)).alias("ka"), F.count(F.when(F.col("t") > 0, 1)).alias("kt")).first()

    def single(kind: str) -> F.Column:
        n, kinds = size[kind] or 0, size[f"k{kind}"]
        return (F.col(kind) + F.lit(kinds / max(1, size.ka))) / F.lit(float(max(1, n + kinds)))

    known = singles.select("gram", single("a").alias("pa"), single("t").alias("pt"))
    for level, bits in ((pairs, BITS), (table, 2 * BITS)):
        context, suffix = F.shiftright("gram", BITS).alias("context"), F.col("gram").bitwiseAND(F.lit((1 << bits) - 1)).alias("suffix")
        total = level.groupBy(context).agg(
            F.sum("a").alias("na"), F.sum("t").alias("nt"), F.count(F.lit(1)).alias("ka"), F.count(F.when(F.col("t") > 0, 1)).alias("kt")
        )
        # A common token follows and precedes many: its rows are dealt over salts, and each salt meets its one row.
        rows = salted_left(level.withColumns({"context": context, "suffix": suffix}), total, "context", "gram")
        rows = salted_left(rows, known.withColumnRenamed("gram", "suffix"), "suffix", "gram")
        p = lambda k: F.when(F.col(f"n{k}") > 0, (F.col(k) + F.col(f"k{k}") * F.col(f"p{k}")) / (F.col(f"n{k}") + F.col(f"k{k}"))).otherwise(F.col(f"p{k}"))
        known = cut(rows.select("gram", F.col("a").alias("n"), p("a").alias("pa"), p("t").alias("pt")))
        known, counted = known.select("gram", "pa", "pt"), known
    return counted.select("gram", "n", (-F.log("pa")).alias("back"), (-F.log("pt" if size.t else "pa")).alias("want"))


def common(table: DataFrame, most: int = HOT) -> DataFrame:
    """The trigrams above the least count that at most `most` of them reach."""
    step = F.floor(F.log2(F.col("n").cast("double")) * 16).cast("int")
    levels = sorted(table.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("k")).collect(), reverse=True)
    held, least = 0, 1 << 30
    for level in levels:
        held += level.k
        if held > most:
            break
        least = level.step
    return table.filter(step >= least)


def score(docs: DataFrame, target: DataFrame, id: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """Per row: doc_id, n_tokens, background_loss, target_loss, score. `target` has the ids of target documents."""
    kind = docs.schema[id].dataType
    own = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    # Target ids grow with the corpus, so they are never broadcast: the join shuffles at every size.
    wanted = target.select(F.col(target.columns[0]).alias("__id")).filter("__id is not null").distinct().hint("merge")
    table = models(own, wanted)
    near = common(table, hot).orderBy("gram").select("gram", "back", "want").toArrow()
    model = docs.sparkSession.sparkContext.broadcast((near.column("gram").to_numpy(), np.stack([near.column(c).to_numpy() for c in ("back", "want")])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, losses = model.value
        for b in byte_slices(batches, 1, CHUNK):
            texts, keys = as_text(b.column(1)), b.column(2).to_numpy()
            tokens, sums = np.zeros(len(texts), np.int64), np.zeros((2, len(texts)))
            for rows, gram in grams(texts):
                tokens += np.bincount(rows, minlength=len(texts))
                at = np.minimum(np.searchsorted(known, gram), max(0, len(known) - 1))
                held = known[at] == gram if len(known) else np.zeros(len(gram), bool)
                for k in (0, 1):
                    sums[k] += np.bincount(rows[held], losses[k][at[held]], len(texts)) if held.any() else 0
                far, n = np.unique(np.rec.fromarrays([keys[rows[~held]], gram[~held]]), return_counts=True)
                yield _rows(pa.nulls(len(far), b.column(0).type), far["f0"], far["f1"], n, 0, 0.0, 0.0)
            yield _rows(b.column(0), keys, None, 1, tokens, *sums)

    fields = [("key", T.LongType()), ("gram", T.LongType()), ("n", T.LongType()), ("n_tokens", T.LongType()), ("back", T.DoubleType()), ("want", T.DoubleType())]
    schema = T.StructType([T.StructField("doc_id", kind), *(T.StructField(n, t) for n, t in fields)])
    found = cut(own.withColumn("key", F.xxhash64(F.coalesce("text", F.lit("")))).mapInArrow(run, schema))
    rows, far = found.filter("gram is null"), found.filter("gram is not null").groupBy("gram", "key").agg(F.sum("n").alias("n"))
    beyond = far.join(table.select("gram", F.col("back").alias("b"), F.col("want").alias("w")), "gram")
    beyond = beyond.groupBy("key").agg(F.sum(F.col("n") * F.col("b")).alias("far_b"), F.sum(F.col("n") * F.col("w")).alias("far_w"))
    copies = rows.groupBy("key").agg(F.count(F.lit(1)).alias("copies"))
    shared = beyond.join(copies, "key").select("key", (F.col("far_b") / F.col("copies")).alias("far_b"), (F.col("far_w") / F.col("copies")).alias("far_w"))
    out = salted_left(rows, shared, "key", "doc_id")
    mean = lambda near, far: (F.col(near) + F.coalesce(far, F.lit(0.0))) / F.col("n_tokens")
    out = out.select("doc_id", "n_tokens", mean("back", "far_b").alias("background_loss"), mean("want", "far_w").alias("target_loss"))
    return out.withColumn("score", F.col("background_loss") - F.col("target_loss"))


def _rows(ids: pa.Array, keys, grams, n, tokens, back, want) -> pa.RecordBatch:
    size = len(ids)
    full = lambda v, kind: pa.array(v if isinstance(v, np.ndarray) else np.full(size, v), kind)
    gram = pa.nulls(size, pa.int64()) if grams is None else pa.array(grams, pa.int64())
    return pa.RecordBatch.from_arrays(
        [ids, full(keys, pa.int64()), gram, full(n, pa.int64()), full(tokens, pa.int64()), full(back, pa.float64()), full(want, pa.float64())],
        ["doc_id", "key", "gram", "n", "n_tokens", "back", "want"],
    )
