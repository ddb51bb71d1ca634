"""LM scores, packing and pieces against brute force."""

import collections
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from brainstate.llm import lm_scoring as lm
from brainstate.llm import packing as pk
from brainstate.llm.pieces import BLANK, MODEL, Vocabulary, with_decoded, with_pieces, with_round_trip

TEXTS = [
    "the cat sat on the mat", "the cat sat", "The CAT ran. a b c d e f g", None, "", "É é\tx\ny", "the dog sat on the mat",
    "a a a a a", "the cat sat on the mat", " \n", "b c d", "cat dog cat dog", "x" * 3000 + " y",
]


def documents(spark, texts=TEXTS, ids=None):
    rows = list(zip(ids or range(len(texts)), texts, ["s"] * len(texts), [0.5] * len(texts), strict=True))
    return spark.createDataFrame(rows, "doc_id long, text string, score string, n_tokens double")


def tokens(text):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower)), None]


def brute_force(rows):
    """Counts, EM without a grid, and scores, by dictionaries."""
    fold = {i: zlib.crc32(str(i).encode()) % 5 for i, _ in rows}
    docs = {i: tokens(t) for i, t in rows}

    def counted(folds):
        one, two = collections.Counter(), collections.Counter()
        for i, own in docs.items():
            if fold[i] in folds:
                one.update(own)
                two.update(zip([None, *own], own, strict=False))
        return one, two

    one, two = counted({0, 2, 3, 4})
    kept1, kept2 = counted({0, 2, 3})
    n, v = sum(one.values()), len(one)

    def parts(a, b, c1, c2, total):
        return np.array([c2[a, b] / max(c1[a], 1), c1[b] / max(total, 1), 1 / (v + 1)])

    events = collections.defaultdict(list)
    for i, own in docs.items():
        if fold[i] == 4:
            for a, b in zip([None, *own], own, strict=False):
                events[kept1[a].bit_length()].append(parts(a, b, kept1, kept2, sum(kept1.values())))
    weights = {}
    for b, rows_ in events.items():
        p, w = np.array(rows_), np.array([0.6, 0.3, 0.1]) if b else np.array([0, 0.9, 0.1])
        for _ in range(lm.STEPS):
            share = w * p
            w = (share / share.sum(axis=1, keepdims=True)).mean(axis=0)
        w = np.maximum(w, [0, 0, 1e-6])
        weights[b] = w / w.sum()
    base = {i: sum(math.log10((one[x] + 0.5) / (n + 0.5 * (v + 1))) for x in own) for i, own in docs.items()}
    return docs, one, two, n, v, weights, base, parts


def test_lm_equals_brute_force(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    docs, one, two, n, v, weights, base, parts = brute_force(rows)
    got = lm.score(spark.read.parquet(f"{small}/documents.parquet"), block_bytes=50_000).collect()
    assert len(got) == len(rows)
    table = {b: weights[b] for b in weights}
    for r in got:
        own = docs[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(one[x] > 0 for x in own), n)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1)
        assert r.base_score == pytest.approx(base[r.doc_id], abs=1e-6)
        total = 0.0
        for a, b in zip([None, *own], own, strict=False):
            bucket = one[a].bit_length()
            if bucket not in table:
                bucket = min((x for x in table if x), key=lambda x: abs(x - bucket)) if bucket else bucket
            w = table.get(bucket, np.array([0, 0.9, 0.1]))
            total += math.log10(float(w @ parts(a, b, one, two, n)) / (w[0] * (one[a] > 0) + w[1] + w[2]))
        assert r.score == pytest.approx(total, rel=0.02, abs=0.5)  # the grid of an eighth of an octave
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_lm_by_levels_equals_one_level(spark, small, monkeypatch):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    one = {r.doc_id: r for r in lm.score(docs, block_bytes=10_000).collect()}
    monkeypatch.setattr(lm, "RANGE", 5_000)
    merges = []
    merging = lm._merging
    monkeypatch.setattr(lm, "_merging", lambda whole, cut: merges.append((whole, cut)) or merging(whole, cut))
    assert {r.doc_id: r for r in lm.score(docs, block_bytes=10_000, fan=5).collect()} == one
    assert len(merges) >= 2 and merges[0] == (5, 5)


def test_rows_asked_grow_with_the_blocks(spark, small, monkeypatch):
    """No block has more than `fan` rows an order, however many blocks and ranges there are."""
    monkeypatch.setattr(lm, "RANGE", 500)
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    blocks = lm.stored(docs.mapInArrow(lm._blocked(10_000), lm._BLOCK), "blocks")
    n, tokens = blocks.agg(F.count("*"), F.sum("n_tokens")).first()
    answers, last = lm.answered(blocks, n, tokens, 6)
    rows = answers.groupBy("order", "block").count()
    assert rows.count() == 2 * n and rows.filter("count > 6").count() == 0
    words = docs.collect()
    training = [x for r in words if lm.fold_of(r.doc_id) != lm.EVALUATED for x in [*lm.tokens_of(r.text), b""]]
    sums = last.filter("order = 1").agg(F.sum("n_all"), F.sum("v_all")).first()
    assert tuple(sums) == (len(training), len(set(training)))


def test_lm_edges(spark):
    got = {r.doc_id: r for r in lm.score(documents(spark)).collect()}
    assert got[3].n_tokens == got[4].n_tokens == got[9].n_tokens == 1
    assert got[0].score == got[8].score or (0 in (0, 8))
    assert all(math.isfinite(r.score) and r.score < 0 for r in got.values())
    assert lm.score(documents(spark, ["a b", "a b"], [None, None])).count() == 2
    assert lm.score(documents(spark, [])).count() == 0


def test_a_models_probabilities_sum_to_one():
    cells = np.array([[3, 40, 20, 5], [3, -9999, 10, 3], [3, -9999, -9999, 1], [0, -9999, 8, 4]])
    for w in lm.learned_weights(cells).values():
        assert sum(w) == pytest.approx(1.0)
        assert w[2] > 0


ENDS = st.sampled_from([*"ab Zé.,!\n\t'<|1  日\0\x1c\x85\xa0\u2003\u2028\u205f\u3000à…", "<|endoftext|>", " a", "'s", "...", "a."])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(ENDS, max_size=20).map("".join), min_size=1, max_size=5))
def test_cached_encoding_equals_the_tokenizer(texts):
    path = public_tokenizers.path(pk.TOKENIZER)
    plain = pk.encoder(path).tokenizer
    ids, at = pk.encoder(path)(pa.array(["x", *texts], pa.string()).slice(1))
    for text, a, b in zip(texts, at[:-1], at[1:], strict=True):
        assert ids[a:b].tolist() == plain.encode(text, add_special_tokens=False).ids


def test_small_cache_gives_the_same_ids(small):
    texts = pq.read_table(f"{small}/documents.parquet")["text"].combine_chunks()
    path = public_tokenizers.path(pk.TOKENIZER)
    whole, at = pk.Encoder(path)(texts)
    tight, found = pk.Encoder(path), []
    with pytest.MonkeyPatch.context() as m:
        m.setattr(pk, "_CACHE", 2000)
        for i in range(0, len(texts), 7):
            found.append(tight(texts.slice(i, 7))[0])
    assert np.concatenate(found).tolist() == whole.tolist() and at[-1] == len(whole)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_bound_and_packing_hold_against_the_best(lengths):
    lengths = np.array(lengths)

    def fits(k, items, bins):
        if not items:
            return True
        seen = set()
        for i, b in enumerate(bins):
            if b >= items[0] and b not in seen:
                seen.add(b)
                if fits(k, items[1:], [*bins[:i], b - items[0], *bins[i + 1 :]]):
                    return True
        return False

    best = next(k for k in range(1, 10) if fits(k, sorted(lengths.tolist(), reverse=True), [20] * k))
    place = pk.best_fit(lengths, 20)
    assert np.bincount(place, weights=lengths).max() <= 20
    assert pk.lower_bound(lengths, 20) <= best <= place.max() + 1


def test_packed_documents(spark, small):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(pk.TOKENIZER))
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    docs = docs.union(documents(spark).selectExpr("doc_id + 100000", "text"))
    ids = {r.doc_id: [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2] for r in docs.collect()}
    items = pk.pieces(docs, public_tokenizers.path(pk.TOKENIZER))
    for group in (8192, 40):
        got = pk.pack(items, group=group).toPandas().sort_values(["sequence_id", "offset"])
        assert got.groupby("doc_id")["length"].sum().to_dict() == {k: len(v) for k, v in ids.items()}
        for r in got.itertuples():
            assert zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
            assert r.piece == 0 or r.length == 1024
        before = got.groupby("sequence_id")["length"].cumsum() - got["length"]
        assert (before == got["offset"]).all()
        assert got.groupby("sequence_id")["length"].sum().max() <= 1024
        assert got["sequence_id"].nunique() <= pk.lower_bound(got["length"].to_numpy()) * 1.02 + 2
    assert pk.pack_documents(documents(spark, [])).count() == 0
    assert pk.pack_documents(documents(spark, ["x", "x", None], [1, 1, None])).count() == 3


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary(public_tokenizers.path(MODEL))


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("the ainé\n日Z.")), max_size=9))
def test_n_best_equals_all_paths(vocabulary, text):
    whole = BLANK + text.replace(" ", BLANK)

    def paths(place):
        """Scores of all segmentations of whole up to place."""
        if place == 0:
            return [0.0]
        out = []
        for start in range(max(0, place - vocabulary.longest), place):
            found = vocabulary.scores.get(whole[start:place])
            if found:
                out += [s + found[1] for s in paths(start)]
        if whole[place - 1] not in vocabulary.scores:
            own = vocabulary.byte_score * len(whole[place - 1].encode())
            out += [s + own for s in paths(place - 1)]
        return out

    ids, scores = vocabulary.encode(text)
    if text:
        best = sorted(paths(len(whole)), reverse=True)[: vocabulary.n_best]
        assert scores == pytest.approx(best)
    assert vocabulary.decode(ids) == text


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("the ainé\n日Z.")), max_size=40))
def test_n_best_ids(vocabulary, text):
    """The ids of each of the n best differ, spell the text and have the score that is given."""
    n_ids, scores = vocabulary.n_encode(text)
    score = {i: s for (i, *more), s in vocabulary.scores.values() if not more} | dict.fromkeys(vocabulary.bytes, vocabulary.byte_score)
    assert len(set(n_ids)) == len(n_ids) == len(scores) and n_ids[0] == vocabulary.encode(text)[0]
    for ids, own in zip(n_ids, scores, strict=True):
        assert vocabulary.decode(ids) == text
        assert sum(score[i] for i in np.frombuffer(ids, "<u4").tolist()) == pytest.approx(own)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("theaing▁\n日Zé1🙂ಠ\u2003")), min_size=1, max_size=64), min_size=1, max_size=9))
def test_shared_passes_equal_single_ones(vocabulary, some):
    for (score, ids, second), own in zip(vocabulary.entries(some), map(vocabulary.entry, some), strict=True):
        assert (score, ids) == own[:2] and second == pytest.approx(own[2], abs=1e-9)


def test_long_and_many_texts(vocabulary, small):
    texts = [x or "" for x in pq.read_table(f"{small}/documents.parquet")["text"].to_pylist()]
    texts += ["", "x" * 3000, "ab " * 3000, "  a  \n\n b ", "▁", texts[0]]
    together = vocabulary.n_encode_all(pa.array(texts))
    for text, (n_ids, scores) in zip(texts, together, strict=True):
        one = Vocabulary.n_encode(vocabulary, text)
        assert (n_ids, scores) == one
        assert {vocabulary.decode(x) for x in n_ids} == {text.replace(BLANK, " ")}


def test_ids_that_spell_no_text(vocabulary):
    whole = np.array([vocabulary.bytes[0x20], vocabulary.bytes[0xE2]], "<u4").tobytes()
    assert vocabulary.decode(whole) == "�" and vocabulary.decode(b"") == ""


def test_n_best_columns(spark):
    rows = with_round_trip(documents(spark)).collect()
    assert rows == with_decoded(with_pieces(documents(spark))).collect()
    for r in rows:
        assert len(set(map(bytes, r.n_ids))) == len(r.scores)
        assert bytes(r.n_ids[0]) == bytes(r.ids) and set(r.n_decoded) == {r.text or ""}


def test_pieces_edges(spark):
    got = with_decoded(with_pieces(documents(spark))).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        assert r.decoded == (r.text or "")
        assert r.scores == sorted(r.scores, reverse=True)
    assert with_pieces(documents(spark, [])).count() == 0
