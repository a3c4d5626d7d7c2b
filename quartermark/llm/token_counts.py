"""Token counts with a public sentencepiece vocabulary, lengths only.

Texts are encoded in batches of about equal bytes inside Arrow functions; the ids never leave the
batch, only their number does. Long texts are split where no piece of the vocabulary can span the cut:
two neighbouring characters that stand side by side in no piece (a space counts as the mark that pieces
have for it) are never merged, so both sides encode on their own as they do together. A part after a cut
gets a guard character in front that no piece holds: it takes the mark that the library puts before
every text, and its own tokens, a constant, are taken off again. Text without such a place
stays whole.

Rows are counted where they lie. Only texts of over SPREAD bytes go to other tasks, in parts, and their
sums are added per text; equal rows are counted together and repeated afterwards.

Null counts as empty and has no bytes and no tokens. Strings of special tokens in a text are ordinary
text, as the library has it. An empty table gives an empty result; repeated rows and null ids give a row each; other columns of the input,
whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartermark.llm.common import byte_slices, per_process

#: Bytes of a batch that is encoded at once.
BATCH = 1 << 20
#: Characters after which a text is split at the next safe place.
PART = 1 << 15
#: Bytes above which the parts of a text are dealt to several tasks.
SPREAD = 1 << 20
#: The character that stands for a space in pieces: a fixed value.
MARK = "▁"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Counter:
    """Numbers of tokens under one sentencepiece file."""

    def __init__(self, path: str):
        import sentencepiece

        self.tool = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.tool.id_to_piece(i) for i in range(self.tool.vocab_size()) if not self.tool.is_control(i)]
        self.inside = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        letters = set("".join(pieces))
        self.guard = next(c for c in map(chr, range(0xE000, 0xF8FF)) if c not in letters)
        self.guard_tokens = len(self.tool.encode(self.guard))

    def safe(self, a: str, b: str) -> bool:
        """Whether the encoder never merges over the border of two neighbouring characters."""
        return (a + b).replace(" ", MARK) not in self.inside

    def parts(self, text: str, size: int) -> Iterator[str]:
        """The text cut at the first safe place after every `size` characters."""
        at, to = 0, size
        while to < len(text):
            if self.safe(text[to - 1], text[to]):
                yield text[at:to]
                at, to = to, to + size
            else:
                to += 1
        yield text[at:]

    def guarded(self, text: str, size: int) -> list[str]:
        """The parts of a text, all but the first behind the guard."""
        first, *rest = self.parts(text, size)
        return [first, *(self.guard + p for p in rest)]

    def lengths(self, texts: list[str], first: list[bool]) -> list[int]:
        """Tokens of guarded parts; those that are not first lose the guard's."""
        found = self.tool.encode(texts, num_threads=1) if texts else []
        return [len(x) - (0 if own else self.guard_tokens) for x, own in zip(found, first)]


def counter(path: str) -> Counter:
    return per_process(("pieces", path), lambda: Counter(path))


def _whole(rows: DataFrame, file: str, batch: int, part: int) -> DataFrame:
    """doc_id, n_bytes, n_tokens of rows that stay in their tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = counter(file)
        for b in byte_slices(batches, 1, batch):
            texts, first, owner = [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                for k, x in enumerate(tool.guarded(text or "", part)):
                    texts.append(x)
                    first.append(k == 0)
                    owner.append(i)
            totals = [0] * b.num_rows
            for i, n in zip(owner, tool.lengths(texts, first)):
                totals[i] += n
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(totals, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_bytes long, n_tokens long")


def _spread(rows: DataFrame, file: str, batch: int, part: int) -> DataFrame:
    """The same for rows whose parts are dealt to several tasks; equal rows share their sums."""
    kind = dict(rows.dtypes)["doc_id"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = counter(file)
        for b in byte_slices(batches, 1, batch):
            for i, text in enumerate(b.column(1).to_pylist()):
                own = b.slice(i, 1)
                for k, x in enumerate(tool.parts(text, part)):
                    columns = [own.column(0), own.column(2), own.column(3), pa.array([k], pa.int64()), pa.array([x])]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "digest", "part", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = counter(file)
        for b in byte_slices(batches, 4, batch):
            first = [k == 0 for k in b.column(3).to_pylist()]
            texts = [x if own else tool.guard + x for x, own in zip(b.column(4).to_pylist(), first)]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(tool.lengths(texts, first), pa.int64())], ["doc_id", "n_bytes", "digest", "part", "n"])

    keyed = rows.withColumn("digest", F.sha2("text", 256)).select("doc_id", "text", "n_bytes", "digest")
    schema = f"doc_id {kind}, n_bytes long, digest string, part long, "
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed.mapInArrow(deal, schema + "text string").repartition(tasks)
    counted = dealt.mapInArrow(run, schema + "n long").groupBy("doc_id", "n_bytes", "digest")
    summed = counted.agg(F.sum("n").alias("n"), F.count_if(F.col("part") == 0).alias("copies"))
    each = F.explode(F.array_repeat(F.expr("n div copies"), F.col("copies").cast("int")))
    return summed.select("doc_id", "n_bytes", each.alias("n_tokens"))


def count(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    limit: int = 4096,
    path: str | None = None,
    batch: int = BATCH,
    part: int = PART,
    spread: int = SPREAD,
) -> DataFrame:
    """Per row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than `limit` tokens)."""
    file = path or default_path()
    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    near = _whole(rows.filter(F.col("n_bytes") <= spread), file, batch, part)
    far = _spread(rows.filter(F.col("n_bytes") > spread), file, batch, part)
    return near.unionByName(far).withColumn("over_limit", F.col("n_tokens") > limit)
