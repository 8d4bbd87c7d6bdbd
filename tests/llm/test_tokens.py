import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from text_fixtures import documents, empty, prose, table
from tokenizers import Tokenizer

from tracewright.llm import packing, token_file, tokens
from tracewright.llm.queries import VOCABULARY
from tracewright.plans.tables import materialize


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(VOCABULARY)


def ids_of(plain, text):
    return np.array(plain.encode(text or "", add_special_tokens=False).ids + [1], "<u4")


def test_encoder_equals_the_tokenizer(plain):
    odd = ["á b", "x\x1cy z", "<|endoftext|> hi", "a<|endoftext|>b", "İstanbul ΣΑΣ", "tab\there\r\nq", "  lead", "日本 語",
           " ", "\n\n", "don't 'll 12 3a", "x " * 3 + "y" * 5000, "Straße, Ärger. é́x ﬁne ŉa ıq İx., a.b .,. don.t ,", "a..", "..",
           None, *(t for _, t, _, _ in documents())]
    for limit in (tokens.MEMO_WORDS, 3):
        coder = tokens.Encoder(VOCABULARY)
        tokens.MEMO_WORDS, before = limit, tokens.MEMO_WORDS
        try:
            for text, got in zip(odd * 2, coder.encode(odd * 2)):
                assert got == ids_of(plain, text)[:-1].tobytes(), text
        finally:
            tokens.MEMO_WORDS = before


def test_letters_with_signs_are_learned_as_letters(plain, monkeypatch):
    """Only the signs go to the whole tokenizer, once for all words that end in them."""
    coder, sent = tokens.Encoder(VOCABULARY), []
    coded = coder._coded
    monkeypatch.setattr(coder, "_coded", lambda pieces: sent.extend(pieces) or coded(pieces))
    texts = ["word&&& other&&& straße,*** end.", "word!! word&&& &&& a.b 12&&& &&&x more&&&", "İx&&& don't,"]
    for text, got in zip(texts, coder.encode(texts)):
        assert got == ids_of(plain, text)[:-1].tobytes(), text
    assert sorted(sent) == sorted(["&&&", ",***", ".", "!!", "a.b", "12&&&", "&&&x", "İx&&&", "don't,"])


@pytest.mark.parametrize("file_ids", [token_file.FILE_IDS, 500])
def test_round_trip(spark, plain, file_ids):
    rows = documents()
    got = token_file.round_trip(table(spark), VOCABULARY, file_ids=file_ids).toPandas()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    start, want = 0, []
    for d, t, _, _ in order:
        ids = ids_of(plain, t)
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    have = [(None if np.isnan(d) else int(d), s, n, c) for d, s, n, c in
            got.sort_values("start")[["doc_id", "start", "n_tokens", "ids_crc32"]].itertuples(index=False)]
    assert have == want


def test_empty_tables(spark):
    assert token_file.round_trip(empty(spark), VOCABULARY).count() == 0
    assert packing.pack_documents(empty(spark), VOCABULARY).count() == 0


@pytest.mark.parametrize("capacity", [packing.Capacity(), packing.Capacity(512, 3, 512.0 ** 2 / 2),
                                      packing.Capacity(512, 4, 512.0 ** 2, (1.0, 0.5, 0.5), "dot")])
def test_pack_documents(spark, plain, capacity):
    got = packing.pack_documents(table(spark), VOCABULARY, capacity=capacity, with_ids=True).collect()
    pieces = defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
    for d, t, _, _ in documents():
        if d is None or d == 220:
            continue
        ids = ids_of(plain, t)
        own = sorted(pieces[d], key=lambda r: r.piece)
        assert [r.start for r in own] == list(range(0, len(ids), capacity.tokens))
        assert np.concatenate([r.ids for r in own]).tolist() == ids.tolist()
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append(r)
    for rows in bins.values():
        rows.sort(key=lambda r: r.offset)
        assert [r.offset for r in rows] == [sum(x.length for x in rows[:i]) for i in range(len(rows))]
        alone = len(rows) == 1
        assert sum(r.length for r in rows) <= capacity.tokens
        assert alone or len(rows) <= capacity.documents
        assert alone or sum(r.length ** 2 for r in rows) <= capacity.attention


def plain_best_fit(sizes, capacity):
    """Every bin stays open; the first of the best ones is taken."""
    bins, out = [], []
    limits = capacity.limits()
    for item in sizes / limits:
        best = None
        for b, free in enumerate(bins):
            left = free - item
            if (left >= -1e-12).all():
                score = (-(free * item * capacity.weights).sum() if capacity.rule == "dot"
                         else (left * left * capacity.weights).sum())
                if best is None or score < best[0] - 1e-15:
                    best = (score, b)
        if best is None:
            bins.append(np.ones(3))
            best = (0, len(bins) - 1)
        bins[best[1]] = bins[best[1]] - item
        out.append(best[1])
    return np.array(out)


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_against_plain_program(rule):
    rng = np.random.default_rng(1)
    capacity = packing.Capacity(100, 6, 5000.0, (1.0, 0.3, 0.2), rule)
    length = np.sort(rng.integers(1, 101, 700))[::-1].astype(float)
    sizes = np.column_stack([length, np.ones(700), length ** 2])
    got, want = packing.vector_best_fit(sizes, capacity), plain_best_fit(sizes, capacity)
    if rule == "norm":
        assert len(set(got)) == len(set(want)) and (got == want).mean() > 0.99
    free = np.array([np.bincount(got, sizes[:, i]) for i in range(3)])
    alone = np.bincount(got) == 1
    assert ((free.T <= capacity.limits() + 1e-9).all(1) | alone).all()


def test_rows_without_id_are_spread(spark):
    rows = [(None, 0, 0, 100, 1)] * 3000 + [(7, 0, 0, 50, 1)] * 3000
    pieces = materialize(spark.createDataFrame(rows, packing.PIECES), "pieces")
    out = packing.pack(pieces, group_items=500)
    sizes = [r["count"] for r in out.groupBy((F.col("sequence_id") % 12).alias("g")).count().collect()]
    assert len(sizes) == 12 and max(sizes) < 800 and out.count() == 6000


def test_ids_must_fit(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    with pytest.raises(Exception, match="do not fit"):
        token_file.write_files(docs, str(tmp_path / "ids"), VOCABULARY, 70_000, dtype="<u2").collect()


def test_few_sequences(spark):
    import random
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.randrange(5, 400)), "en", "s") for i in range(800)]
    got = packing.pack_documents(table(spark, rows), VOCABULARY).toPandas()
    assert got["sequence_id"].nunique() <= np.ceil(got["length"].sum() / 4096 * 1.01) + 1
