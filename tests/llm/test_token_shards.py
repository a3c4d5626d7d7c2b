import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quartermark.llm import token_shards
from quartermark.llm.common import per_process

PATH = token_shards.default_path()
PLAIN = Tokenizer.from_file(PATH)
ODD = "aBhH1\xe9\xc9's\xdf  \n\t\r\x0b\x1c\x85\xa0 　​̱́\U0001f600中\0<|>endoftextsar.,!?;:-_Σİ "


def plain(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(st.sampled_from(ODD) | st.characters(blacklist_categories=["Cs"]), max_size=50), max_size=4))
def test_equals_the_library(texts):
    tool = per_process("words", lambda: token_shards.WordEncoder(PATH, cache=500))
    texts = texts + ["The, the. END! end$$$ \xc9T\xc9| \xdf. \xff! it'. it's' \xd7x x\xf7. a<|b", "<|ENDOFTEXT|> <|endoftext|>. <|startoftext|>", "don't I'LL.", "H̱ ẖ."]
    assert [np.frombuffer(x, "<u2").tolist() for x in tool.encode(texts)] == [plain(t) for t in texts]


def test_perfect_hash_is_minimal():
    rng = random.Random(1)
    for n in (0, 1, 2, 63, 5000):
        keys = np.array(sorted(set(rng.getrandbits(63) - (1 << 62) for _ in range(n))), np.int64)
        index = token_shards.PerfectHash.build(keys)
        assert sorted(index.slots(keys).tolist()) == list(range(len(keys))) and index.size == len(keys)


def test_write_scan_and_fetch(spark):
    rng = random.Random(2)
    rows = [(i * 7 - 300, " ".join(rng.choice(["the", "End.", "\xe9t\xe9", "x1"]) for _ in range(rng.randint(0, 40)))) for i in range(400)]
    rows += [(None, "no key"), (None, None), (5000, None), (5001, ""), (5002, "word " * 60_000), (14, "again"), (14, "again")]
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, start int").repartition(5)
    manifest = token_shards.write(df)
    got = token_shards.scan(manifest).collect()
    want = {}
    for i, t in rows:
        want.setdefault(i, []).append(np.array([*plain(t), 1], "<u4").tobytes())
    have = {}
    for r in got:
        have.setdefault(r.doc_id, []).append(r.ids)
        assert r.n_tokens == len(r.ids) // 4
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    in_order = sorted(got, key=lambda r: r.start)
    assert [(r.doc_id is not None, r.doc_id or 0) for r in in_order] == sorted((i is not None, i or 0) for i, _ in rows)
    at = 0
    for r in in_order:
        assert r.start == at
        at += r.n_tokens
    ask = spark.createDataFrame([(14,), (5002,), (-300,), (-301,), (9999,), (16,), (None,)], "doc_id long")
    found = {r.doc_id: r.ids for r in token_shards.fetch(manifest, ask).collect()}
    assert found.keys() == {14, 5002, -300} and found[5002] == want[5002][0] and found[-300] == want[-300][0] and found[14] in want[14]
    digests = {(r.doc_id, r.ids_crc32) for r in token_shards.written_and_read(spark, df).collect()}
    assert digests == {(k, zlib.crc32(x)) for k, v in want.items() for x in v}


def test_empty_table(spark):
    assert token_shards.written_and_read(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0
