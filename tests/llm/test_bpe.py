import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from epochal.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def machine():
    with open(PATH, encoding="utf-8") as f:
        return bpe.Automaton(f.read())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


PARTS = st.sampled_from([" ", "  ", "\n", "\t", "a", "aaa", "the", "'s", "'", "12", "é", "中", "🙂", "<|endoftext|>", "===", "-", "\r", "\x1c", "\x85", "　", "zz", "tion"])


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.lists(PARTS, max_size=30).map("".join)))
def test_as_the_library(machine, library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    assert machine.encode(text) == ids
    assert machine.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_every_token_is_its_own_path(machine):
    assert all(machine.path(label) == (i,) for label, i in list(machine.whole.items())[::50])


def test_arcs_agree_with_the_library(machine, library):
    """Two tokens may follow each other just if the library, given their text as one word, returns them."""
    words = [w for w in machine.whole if w.isalpha() and w.isascii()][::400]
    for a in words[:60]:
        for b in words[:60]:
            u, v = machine.whole[a], machine.whole[b]
            assert machine.follows(u, v) == (library.encode((a + b).decode(), add_special_tokens=False).ids == [u, v])


def test_long_texts_in_pieces(machine, library, monkeypatch):
    monkeypatch.setattr(bpe, "PIECE", 50)
    text = "the quick  brown fox's 12 \n jumps over été " * 40
    assert machine.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_whole_table(spark, small, library):
    got = {r.doc_id: r for r in bpe.token_digests(small, PATH).collect()}
    for r in small.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_odd(odd, none):
    rows = odd.filter("doc_id is not null").dropDuplicates(["doc_id"])
    back = {r.doc_id: r.text for r in bpe.decode_documents(bpe.encode_documents(rows, PATH), PATH).collect()}
    assert back == {r.doc_id: r.text or "" for r in rows.collect()}
    got = {r.doc_id: r for r in bpe.token_digests(odd, PATH).collect()}
    assert got[3].n_tokens == 0 and got[3].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert bpe.token_digests(none, PATH).count() == 0


def test_long_words(machine, library):
    """Time is linear in a word, whatever it repeats."""
    import random
    import time

    draw = random.Random(0)
    for text in ("ab" * 500_000, "a" * 1_000_000, "=" * 1_000_000, "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000))):
        began = time.time()
        assert machine.encode(text) == library.encode(text, add_special_tokens=False).ids
        assert time.time() - began < 60
