"""Token alignment against a byte-by-byte computation."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidegauge.llm import alignment, queries

A, B = f"{queries.TOKENIZERS}/byte_bpe_50k.json", f"{queries.TOKENIZERS}/piece_bpe_32k.model"
COUNTS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


@pytest.fixture(scope="module")
def direct():
    """rows: (doc_id, text). The definition, token by token and byte by byte."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    letters = alignment.byte_letters()

    def tokens(text):
        if not text:
            return [], []
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        spelled_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
        spelled_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids_b, b.id_to_piece(ids_b))]
        if b"".join(spelled_a) != (" " + text).encode() or b"".join(spelled_b) != (" " + text).encode():
            return [], []
        return list(zip(ids_a, spelled_a)), list(zip(ids_b, spelled_b))

    def run(rows):
        made, count = [], Counter()
        for d, text in rows:
            ta, tb = tokens(text)
            owner_a, owner_b = ([i for i, (_, s) in enumerate(t) for _ in s] for t in (ta, tb))
            links = sorted(set(zip(owner_a, owner_b)))
            ends_a, ends_b = (np.cumsum([len(s) for _, s in t]).tolist() for t in (ta, tb))
            groups, i, j = [], 0, 0
            for end in sorted(set(ends_a) & set(ends_b)):
                x, y = ends_a.index(end) + 1, ends_b.index(end) + 1
                groups.append(",".join(str(k) for k, _ in ta[i:x]) + "|" + ",".join(str(k) for k, _ in tb[j:y]))
                i, j = x, y
            links = [(ta[x][0], tb[y][0]) for x, y in links]
            count.update(links)
            made.append((d, len(ta), len(tb), groups, links))
        best = defaultdict(int)
        for (_, y), n in count.items():
            best[y] = max(best[y], n)
        return sorted(((d, na, nb, len(g), len(ls), sum(count[x] == best[x[1]] for x in ls), sum(count[x] for x in ls), ";".join(g)) for d, na, nb, g, ls in made), key=str)
    return run


def rows_of(df):
    return sorted(((r.doc_id, *(r[c] for c in COUNTS), r.groups) for r in df.collect()), key=str)


ODD = [None, "", " ", "a", " a  b", "Hello world, this is a test.", "Ünïcödé ça va? 日本語テキスト 🙂🙂", "tabs\tand\nnew lines\r\n\r\n", "<|endoftext|> <s> </s> <unk> <0x41>",
       "x" * 3000, "  ﻿", "a\u0000b", "▁ real underline ▁", "1234567890 " * 50, "ﬁ ligature ½ ①", "é combining", "   leading", "trailing   ", "Hello world, this is a test."]


def test_odd_texts(docs_of, direct):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "a null id"), (3, "a"), (3, "b")]
    got, want = rows_of(alignment.align(docs_of(rows), A, B)), direct(rows)
    assert got == want
    assert sum(r[1] > 0 for r in got) > 12 and sum(r[3] != r[4] for r in got) > 3


def test_sample_in_small_slices(spark, sample, direct, monkeypatch):
    """Many slices, shards and flushes."""
    monkeypatch.setattr(alignment, "SHARD_BYTES", 1_000)
    docs = sample("documents").repartition(7)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert rows_of(alignment.align(docs, A, B)) == direct(rows)


def test_query_digest(spark, direct):
    folder = "/root/testdata/sf0.001"
    got = {r.doc_id: (r.n_groups, r.groups_sha256) for r in queries.op11_alignment(spark, folder).collect()}
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert got == {r[0]: (r[3], hashlib.sha256(r[7].encode()).hexdigest() if r[3] else "") for r in direct(rows)}


def test_empty_and_clashing(docs_of, direct):
    assert alignment.align(docs_of([]), A, B).collect() == []
    rows = [(1, "some words here"), (2, None)]
    odd = docs_of(rows).withColumn("slice", F.lit(5)).withColumn("n", F.lit("x")).withColumn("groups", F.lit(1)).withColumn("data", F.lit(2))
    assert rows_of(alignment.align(odd, A, B)) == direct(rows)
    assert rows_of(alignment.align(docs_of([(1, None), (2, "")]), A, B)) == [(1, *[0] * 6, ""), (2, *[0] * 6, "")]


def test_hot_token_and_long_text(docs_of, direct):
    rows = [(i, "the the the the") for i in range(300)] + [(1000, "the quick brown fox " * 2_000)]
    assert rows_of(alignment.align(docs_of(rows), A, B)) == direct(rows[:300] + [(1000, rows[-1][1])])


def test_both_encoders_of_the_byte_level_vocabulary(spark):
    """The faster one gives the same ids on every kind of character, and is refused where merges are out of order."""
    import json
    with open(A, "rb") as a, open(B, "rb") as b:
        files = a.read(), b.read()
    t = alignment.load(*files)
    assert t.fast_a is not None
    texts = [f" a{chr(c)}b {chr(c)}1 {chr(c)}{chr(c)}'s.{chr(c)} " for c in [*range(0, 0x3000), *range(0x3000, 0x110000, 37)] if not 0xD800 <= c <= 0xDFFF]
    texts += ["x" * 5000, "ab " * 4000, " \n\n\t  " * 300, "<|endoftext|>"]
    assert [t.fast_a.encode_ordinary(x) for x in texts] == [e.ids for e in t.a.encode_batch_fast(texts, add_special_tokens=False)]
    odd = json.loads(files[0])
    odd["model"]["merges"] = odd["model"]["merges"][::-1]
    spelled = {x: i for i, x in enumerate(t.bytes_a) if x}
    assert alignment.ranked(odd, spelled) is None and alignment.ranked(json.loads(files[0]) | {"normalizer": {"type": "NFC"}}, spelled) is None
