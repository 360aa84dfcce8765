"""Packing: token ids, cuts, and a gapless layout with little padding."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from samples import frame
from tokenizers import Tokenizer

from provweave.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def check(packed, rows, size):
    tokenizer = Tokenizer.from_file(PATH)
    want = Counter()
    for i, t, *_ in rows:
        want[i, tuple(ids_of(tokenizer, t))] += 1
    pieces = defaultdict(list)
    for r in packed:
        own = np.frombuffer(r["ids"], "<u4")
        assert len(own) == r["length"] and zlib.crc32(own.tobytes()) == r["ids_crc32"]
        pieces[r["doc_id"], r["doc_tokens"]].append((r["start"], own.tolist()))
    for (i, n), found in pieces.items():
        times = sum(c for (j, ids), c in want.items() if j == i and len(ids) == n)
        assert sum(len(p) for _, p in found) == n * times
    layout = defaultdict(list)
    for r in packed:
        layout[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in layout.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= size
    return layout


@pytest.mark.parametrize("size", [64, 4096])
def test_layout_and_ids(spark, docs, rows, size):
    packed = packing.pack_documents(docs, PATH, size=size).collect()
    layout = check(packed, rows, size)
    total = sum(r["length"] for r in packed)
    assert len(layout) <= -(-total // size) * 1.1 + 1
    tokenizer = Tokenizer.from_file(PATH)
    by_doc = defaultdict(list)
    for r in packed:
        by_doc[r["doc_id"]].append((r["start"], np.frombuffer(r["ids"], "<u4").tolist()))
    for i, t, *_ in rows:
        assert sum((p for _, p in sorted(by_doc[i])), []) == ids_of(tokenizer, t)


def test_repeated_rows_null_ids_and_nothing(spark, no_docs):
    rows = [(1, "same text here", None, None)] * 3 + [(None, "other", None, None)] * 2
    check(packing.pack_documents(frame(spark, rows), PATH, size=8).collect(), rows, 8)
    assert packing.pack_documents(no_docs, PATH).count() == 0


@pytest.mark.parametrize("text", ["Straße ΑΣ ΣΑΣ İstanbul", "été café", "it's we'll <|endoftext|> a<|startoftext|>b", "a b c\x1cd\x85e", "1234 x1y2 ½²", "日本語 текст 😀!?", "don't DON'T L'été «quoted»", "\x00\x01 soft­hyphen"])
def test_words_give_the_ids_of_the_text(text):
    tokenizer = Tokenizer.from_file(PATH)
    assert ids_by(packing.WordIds(PATH), [text]) == [ids_of(tokenizer, text)]


def ids_by(words, texts):
    raw = [(t or "").encode() for t in texts]
    found, cuts = words.of(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), 2)
    return [found[a:b].tolist() for a, b in zip(cuts, cuts[1:])]


@pytest.mark.parametrize("most", [1, 5, 200])
def test_remembered_words_do_not_change_ids(monkeypatch, rows, most):
    monkeypatch.setattr(packing, "REMEMBERED", most)
    monkeypatch.setattr(packing, "PIECES", 3)
    monkeypatch.setattr(packing, "NEW", most // 3)
    words, tokenizer = packing.WordIds(PATH), Tokenizer.from_file(PATH)
    texts = [r[1] for r in rows]
    for some in (texts, texts[:9], texts[9:], texts):
        assert ids_by(words, some) == [ids_of(tokenizer, t) for t in some]
    assert len(words.known.keys) == len(words.known.first) and len(words.new.keys) <= max(1, most)


def test_words_of_one_hash_keep_their_own_ids(monkeypatch, rows):
    keys = packing.blocks.word_keys
    monkeypatch.setattr(packing.blocks, "word_keys", lambda *a: (keys(*a)[0] & np.uint64(7), keys(*a)[1]))
    words, tokenizer = packing.WordIds(PATH), Tokenizer.from_file(PATH)
    for t in (rows[0][1], rows[1][1], "a b", "c", rows[0][1]):
        assert ids_by(words, [t]) == [ids_of(tokenizer, t)]


def test_histogram_packing_places_every_piece():
    rng = np.random.default_rng(1)
    for histogram in ({}, {10: 1}, {10: 5, 3: 7}, {int(k): int(v) for k, v in zip(rng.integers(1, 65, 40), rng.integers(1, 300, 40))}):
        placed = packing.shortest_pack_first(histogram, 64)
        load = Counter()
        segments = sorted(zip(*(placed[k].tolist() for k in ("length", "rank", "pack", "each", "offset"))))
        for j, (length, rank, pack, each, _) in enumerate(segments):
            end = segments[j + 1][1] if j + 1 < len(segments) and segments[j + 1][0] == length else histogram[length]
            for r in range(rank, end):
                load[pack + (r - rank) // each] += length
        assert max(load.values(), default=0) <= 64 and sum(load.values()) == sum(k * v for k, v in histogram.items())
        assert set(load) == set(range(len(load)))
