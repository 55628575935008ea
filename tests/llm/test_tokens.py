"""Token ids, decoding and pieces."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skeinwork.llm.bpe import VOCABULARY, StreamDecoder, Transducer, decode, encode, encoder_of, load_ranks, read_vocabulary
from skeinwork.llm.split import PARAGRAPH, SENTENCE, WORD, _Shapes, merge_segments, piece_bounds, split_texts, surely_fits

import numpy as np

ENCODER = encoder_of(read_vocabulary(VOCABULARY))
tokenizers = pytest.importorskip("tokenizers")
PUBLIC = tokenizers.Tokenizer.from_file(VOCABULARY.replace(".tiktoken", ".json"))
PUBLIC.encode_special_tokens = True


def public(text):
    return PUBLIC.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    assert ENCODER.encode(text).tolist() == public(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab'st \n\t-=0é漢", max_size=80))
def test_awkward_text(text):
    assert ENCODER.encode(text).tolist() == public(text)


@pytest.mark.parametrize("alphabet", ["a", "-=", "etaoin", "é漢😀", " \n"])
def test_long_runs(alphabet):
    random.seed(1)
    text = "".join(random.choice(alphabet) for _ in range(4000))
    assert ENCODER.encode(text).tolist() == public(text)


def test_small_state_limit():
    small = Transducer(load_ranks(read_vocabulary(VOCABULARY)), state_limit=20)
    for word in ["tokenisation", " unbelievably", "xqzjk" * 30]:
        assert small.encode_piece(word.encode()) == public(word)


def test_neighbours_match_plain_merging():
    random.seed(2)
    t = ENCODER.transducer
    ids = list(t.bytes_of)
    for _ in range(3000):
        a, b = random.choice(ids), random.choice(ids)
        parts = [t.bytes_of[a], t.bytes_of[b]]
        assert t.may_follow(a, b) == (t.merge_all(parts[0] + parts[1]) == parts)


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=40), st.integers(1, 5))
def test_streaming_equals_whole(data, step):
    bytes_of = {k: bytes([k]) for k in range(256)}
    stream = StreamDecoder(bytes_of)
    out = "".join(stream.feed(data[k : k + step]) for k in range(0, len(data), step)) + stream.close()
    assert out == data.decode("utf-8", "replace")


TEXTS = [(1, "Hello <|endoftext|> world"), (2, None), (3, ""), (4, "  \n "), (5, "é" * 9000), (None, "no id"), (1, "Hello <|endoftext|> world"), (6, "漢字 and عربى 😀")]


def test_table(spark):
    df = spark.createDataFrame([(a, b, 7, "x") for a, b in TEXTS], "doc_id long, text string, ids int, batch string")
    out = encode(df).collect()
    assert sorted((str(r["doc_id"]), r["ids"]) for r in out) == sorted((str(a), public(b) if b else []) for a, b in TEXTS)
    back = decode(encode(df)).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in back) == sorted((str(a), b or "") for a, b in TEXTS)
    assert encode(df.limit(0)).count() == 0 and decode(encode(df.limit(0))).count() == 0
    assert decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")).first()["text"] is None


def slow_merge(sizes, strengths, room):
    parts = [[k, s] for k, s in enumerate(sizes)]
    while True:
        fits = [(strengths[parts[k + 1][0]], parts[k][1] + parts[k + 1][1], parts[k][0], k) for k in range(len(parts) - 1) if parts[k][1] + parts[k + 1][1] <= room]
        if not fits:
            return [p[0] for p in parts]
        k = min(fits)[3]
        parts[k][1] += parts.pop(k + 1)[1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 6), st.sampled_from([0, 0, 1, 1, 2, 3])), min_size=1, max_size=30))
def test_merging_matches_heap_definition(cells):
    sizes, strengths = np.array([c[0] for c in cells]), np.array([PARAGRAPH, *(c[1] for c in cells[1:])])
    assert merge_segments(sizes, strengths, 12).tolist() == slow_merge(sizes.tolist(), strengths.tolist(), 12)


def test_pieces(spark):
    random.seed(4)
    words = lambda n: " ".join(random.choice("the cat sat on mats near an old house".split()) for _ in range(n))
    texts = {
        1: "\n\n".join(words(120) + "." for _ in range(20)),
        2: ". ".join(words(30) for _ in range(200)),
        3: "x1y2z3" * 3000,
        4: "漢字テスト" * 2000,
        5: "short text",
        6: words(5000),
        7: "a\n\n  b " * 2000 + "don't  stop\n",
    }
    df = spark.createDataFrame([(k, v, 1, 2) for k, v in texts.items()] + [(8, None, 1, 1), (9, "", 1, 1), (5, "short text", 1, 1)], "doc_id long, text string, piece int, pieces int")
    rows = split_texts(df).collect()
    assert {r["doc_id"] for r in rows} == set(texts)
    for doc, text in texts.items():
        ids = public(text)
        own = sorted((r["piece"], r["start_token"], r["end_token"], r["text"]) for r in rows if r["doc_id"] == doc)
        if doc == 5:
            assert own == [(0, 0, len(ids), text)] * 2
            continue
        assert [p[0] for p in own] == list(range(len(own))) and len(own) > 1
        assert own[0][1] == 0 and own[-1][2] == len(ids)
        assert all(z - a <= 1024 for _, a, z, _ in own)
        assert all(x[2] - y[1] == 64 for x, y in zip(own, own[1:]))
        assert all(t == PUBLIC.decode(ids[a:z]) for _, a, z, t in own)
        if doc in (1, 2, 6):
            assert all(PUBLIC.decode([ids[z]])[0] == " " or PUBLIC.decode(ids[:z]).endswith("\n\n") for _, _, z, _ in own[:-1])
        if doc == 1:  # paragraphs fit, so none is cut
            assert all(PUBLIC.decode(ids[:z]).endswith(".\n\n") for _, _, z, _ in own[:-1])
    found = split_texts(df, with_text=False, only_split=True).filter("piece = 0").select("doc_id")
    assert {r[0] for r in found.collect()} == {k for k, v in texts.items() if len(public(v)) > 1024}
    assert split_texts(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        split_texts(df, limit=10, overlap=10)


def test_boundaries():
    text = 'One two. "Three four!" Five\nsix\n\nseven,eight'
    from skeinwork.llm.split import boundary_strengths

    shapes = _Shapes(ENCODER)
    pieces = ENCODER.split(text)
    s = boundary_strengths(np.array([shapes[p] & 255 for p in pieces]))
    at = {pieces[k].strip() + str(k): int(v) for k, v in enumerate(s)}
    by = {k.rstrip("0123456789"): v for k, v in at.items()}
    assert by["two"] == WORD and by["Five"] == SENTENCE and by["six"] == SENTENCE and by["seven"] == PARAGRAPH and by["eight"] == 0


def test_exact_limit():
    shapes = _Shapes(ENCODER)
    text = " cat" * 1024
    assert piece_bounds(ENCODER, shapes, ENCODER.split(text), 1024, 64) == [(0, 1024)]
    assert len(piece_bounds(ENCODER, shapes, ENCODER.split(text + " cat"), 1024, 64)) == 2
    assert surely_fits(ENCODER, ENCODER.split(text), 1024) and not surely_fits(ENCODER, ENCODER.split(text + " cat"), 1024)
