from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from sablelens.llm.encoding import known, vocabulary
from sablelens.llm.token_counts import spliced_count, token_counts
from sablelens.llm.token_files import Segment, pack_segment, read_dictionary, read_document, read_token_files, write_token_files
from tests.llm.conftest import prose


@pytest.fixture(scope="module")
def words():
    return vocabulary(known("byte_bpe_50k.json"))


def test_pieces_give_the_librarys_ids(words):
    random.seed(3)
    letters = ["a", "bc", " ", "\n", "\t", "'s", "1", "!", "é", " ", "<|endoftext|>", "\x1c", "　", " x", "日本"]
    texts = ["".join(random.choice(letters) for _ in range(random.randint(0, 40))) for _ in range(3000)] + [prose(1, 50), "", " ", "  a"]
    assert [np.frombuffer(x, words.kind).tolist() for x in words.ids(texts)] == words.plain(texts)


@pytest.mark.parametrize("text", [prose(1, 3000), "x" * 5000 + " y" + "\n\n" * 3000 + " ab cd" * 2000, "é " * 4000, "a" * 9000, " " * 7000 + "z"])
def test_overlap_resynchronisation(words, text):
    assert spliced_count(text, words, chunk=1000, overlap=8) == len(words.plain([text])[0])


def test_sentencepiece_counts(odd):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=known("piece_bpe_32k.model"))
    got = sorted(r["n_tokens"] for r in token_counts(odd, "piece_bpe_32k.model").collect())
    assert got == sorted(len(model.encode(r["text"] or "")) for r in odd.collect())


def test_token_counts_edge_cases(odd, make, words):
    got = token_counts(odd).collect()
    want = sorted(((r["doc_id"], len((r["text"] or "").encode()), len(words.plain([r["text"] or ""])[0])) for r in odd.collect()), key=repr)
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got), key=repr) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 1024) for r in got)
    assert token_counts(make([])).count() == 0


def test_token_files_round_trip(spark, make, words, tmp_path):
    rows = [(k * 3 % 101, prose(k, k % 30)) for k in range(101)] + [(None, "null id"), (7, "twice"), (7, "twice again"), (500, None), (501, prose(9, 20_000))]
    path = write_token_files(make(rows), f"file://{tmp_path}/tokens")
    got = read_token_files(spark, path).orderBy("start").collect()
    assert len(got) == len(rows)
    ids = [r["doc_id"] for r in got]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    at, texts = 0, {}
    for i, t in rows:
        texts.setdefault(i, []).append(words.plain([t or ""])[0] + [0])
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
        found = [x for x in texts[r["doc_id"]] if zlib.crc32(np.array(x, "<u4").tobytes()) == r["ids_crc32"] and len(x) == r["n_tokens"]]
        texts[r["doc_id"]].remove(found[0])
    assert read_document(spark, path, 501)[0].tolist() == words.plain([rows[-1][1]])[0] + [0]
    assert sorted(len(x) for x in read_document(spark, path, 7)) == sorted(len(words.plain([t])[0]) + 1 for i, t in rows if i == 7)


def test_segment_needs_its_dictionary(spark, make, tmp_path):
    raw = pack_segment([(1, 1, b"")], 2, b"abc")
    with pytest.raises(ValueError):
        Segment(raw, b"abd")
    path = write_token_files(make([]), f"file://{tmp_path}/none")
    assert read_dictionary(spark, path) == b"" and read_token_files(spark, path).count() == 0
