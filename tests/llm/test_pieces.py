"""Piece encoding against the library whose models it reads: ids, spans of source bytes, and decoding."""

import hashlib

import pytest
import sentencepiece
from conftest import *  # noqa: F403
from hypothesis import given, settings
from hypothesis import strategies as st

from skeinwork.llm import pieces, queries

SF = "/root/testdata/sf0.001"
BASE = queries.piece_model()


def variant(rule, prefix, squeeze, escape):
    """The model with another normaliser: a repeated field of a message is merged into the first."""
    return BASE + sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto() + bytes([26, 6, 24, prefix, 32, squeeze, 40, escape])


MODELS = {"base": BASE, "map": variant("nmt_nfkc", 0, 0, 1), "fold": variant("nfkc_cf", 1, 1, 1), "squeeze": variant("identity", 0, 1, 1), "bare": variant("nfkc", 0, 1, 0)}
PAIRS = {n: (pieces.PieceModel.parse(m), sentencepiece.SentencePieceProcessor(model_proto=m)) for n, m in MODELS.items()}


def agree(name, text):
    own, library = PAIRS[name]
    ids, starts, ends = own.encode(text)
    want = library.encode(text, return_type="proto").pieces
    assert ids.tolist() == [p.id for p in want]
    assert list(zip(starts.tolist(), ends.tolist())) == [(p.begin, p.end) for p in want]
    if name != "bare":
        assert own.decode(ids) == library.decode(ids.tolist())


@pytest.mark.parametrize("name", sorted(MODELS))
def test_odd_texts(name):
    for text in ["", " ", "  a", "\n", "▁▁x", " ▁ ", "a\0b", "<s> <unk> <0x41>", "x" * 700, " " * 100, "\t a  b ", "ﬁ ½　", "각", "é́", "ab▁cd ef▁", "﻿a", "�⁇ ⁇", "🎉日本"]:
        agree(name, text)


@pytest.mark.parametrize("name", sorted(MODELS))
@settings(max_examples=300, deadline=None)
@given(text=st.one_of(st.text(max_size=60), st.text("ab the▁\n ﬁÅé́㌀가🎉", max_size=60)))
def test_against_library(name, text):
    agree(name, text)


@settings(max_examples=300, deadline=None)
@given(ids=st.lists(st.one_of(st.integers(0, 31999), st.integers(0, 300)), max_size=12))
def test_decoding(ids):
    own, library = PAIRS["base"]
    assert own.decode(ids) == library.decode(ids)


def test_long_texts_are_cut_without_a_trace(monkeypatch, docs):
    monkeypatch.setattr(pieces, "RUN_CHARS", 7)
    monkeypatch.setattr(pieces, "CACHED_PARTS", 3)
    for r in docs.collect():
        agree("base", r["text"] or "")


def test_models_of_other_kinds_are_refused():
    with pytest.raises(ValueError):
        pieces.PieceModel.parse(BASE + bytes([18, 2, 24, 1]))


def test_operator_on_odd_rows(spark, docs, no_docs):
    clash = docs.withColumn("ids", docs["doc_id"]).withColumn("__pieces", docs["doc_id"])
    got = pieces.decode(pieces.encode(clash, BASE), BASE)
    assert got.columns == [*docs.columns, "__pieces", "ids", "starts", "ends", "decoded"]
    both = pieces.encode(clash, BASE, decoded=True)
    assert both.columns == got.columns and sorted(map(str, both.collect())) == sorted(map(str, got.collect()))
    for r in got.collect():
        data = (r["text"] or "").encode()
        assert r["decoded"] == (r["text"] or "") and [*r["starts"], len(data)][1:] == r["ends"] if r["ids"] else not data
    assert pieces.encode(no_docs, BASE).count() == 0


def test_query_against_library(spark):
    library = PAIRS["base"][1]
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.QUERIES["op12_piece_encoding"](spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = library.encode(r["text"] or "")
        assert got[r["doc_id"]] == (len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), library.decode(ids))))
