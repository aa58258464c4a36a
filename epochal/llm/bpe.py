"""BPE encoding and decoding by a tokenization automaton.

The automaton reads tokens. It starts as one state with an arc per byte and is built once, by one gadget per merge, in order: for
the merge of a and b into ab, whatever state an a-arc leads to loses its b-arc (a and b would have merged), and every state with
that a-arc gets an ab-arc to a copy of the state that the b-arc led to. All arcs with one label lead to one state, so states are
named by labels. The whole table has 2.5e9 arcs, of which 7e7 are missing between labels of words, so a gadget writes down only what it
changes: the arc that a state lost, and the state of which the new one is a copy and the arc beside which the new arc lies, both as of
that gadget. Those are default arcs: what a state has no entry for is as in the state that it was copied from. Arcs that were once
found are kept in a plain table. A merge whose gadget finds no arc (`whole` lacks it) makes a label that no text has.

A token sequence is BPE's own exactly if the automaton accepts it, and each string is spelled by one accepted path. So every prefix
of a word has one last label. Encoding reads a word byte by byte: a second table (of prefixes of labels, with failure arcs) steps to the
longest label that ends there, and the last label of the prefix is the longest of it and the shorter ones that end there whose arc
leaves the prefix before it. That is linear in the word. Decoding emits the labels of the path's arcs.

Defined cases: null and empty texts have no tokens (the digests are those of the empty string); the special token's string in a
text becomes the special id, as the tokenizers library has it; texts of any length go through in pieces cut where a token ends
in any case.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from epochal.llm.common import kept, spread, table

#: The word pattern of byte-level BPE (a fixed value of the format).
PRE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words whose paths a worker remembers, and characters of text that it splits at once.
REMEMBERED, PIECE = 250_000, 1 << 20


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins of bytes in vocabulary files: printable Latin-1 stands for itself, the rest follows from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Paths(dict):
    """The paths of words, found when first asked for. Holds two generations of words, so that common ones outlive the rest; long
    words aren't kept."""

    def __init__(self, find: Callable[[bytes], tuple[int, ...]]):
        self.find, self.older = find, {}

    def __missing__(self, word: str) -> tuple[int, ...]:
        found = self.older.get(word)
        if found is None:
            found = self.find(word.encode())
        if len(word) < 64:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[word] = found
        return found


class Automaton:
    def __init__(self, spec: str):
        """spec: the JSON of a byte-level BPE of the tokenizers library."""
        read = json.loads(spec)
        vocab, symbols = read["model"]["vocab"], byte_symbols()
        spelled = lambda s: bytes(symbols[c] for c in s)
        self.label = {i: spelled(s) for s, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in read.get("added_tokens", [])}
        self.label |= {i: s.encode() for s, i in self.special.items()}
        count = max(self.label) + 1
        #: By label: the gadget that made its state (-1: the first state), the label beside whose arcs its arcs lie, and the label
        #: whose state its state is a copy of. By state and label: the gadget that took the arc.
        self.made, self.beside, self.copied = [-1] * count, [-1] * count, [-1] * count
        self.lost: dict[int, int] = {}
        self.arcs: dict[int, bool] = {}
        self.whole = {self.label[i]: i for i in vocab.values() if len(self.label[i]) == 1}
        for k, pair in enumerate(read["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.add_gadget(k, vocab[a], vocab[b], vocab[a + b])
        self.read_labels()
        self.split = regex.compile(PRE_SPLIT).findall
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.paths = Paths(self.path)
        self.names = {i: str(i) for i in self.label}

    def add_gadget(self, k: int, a: int, b: int, ab: int) -> None:
        if self.label[a] in self.whole and self.label[b] in self.whole and self.arc(a, b):
            self.whole[self.label[ab]] = ab
        self.made[ab], self.beside[ab], self.copied[ab] = k, a, b
        self.lost[a << 32 | b] = k

    def arc(self, u: int, v: int) -> bool:
        """Whether the state after u has a v-arc."""
        lost, made, beside, copied, until = self.lost.get, self.made, self.beside, self.copied, 1 << 60
        while True:
            if lost(u << 32 | v, until) < until:
                return False
            nu, nv = made[u], made[v]
            if nu < 0 and nv < 0:
                return True
            if nu == nv:  # u is v: the gadget laid the new arc into a state that has lost nothing since
                u, v, until = copied[u], beside[v], nu
            elif nu > nv:  # as in the state that u's was copied from
                u, until = copied[u], nu
            else:  # as the arc beside it; of two equal pairs the left one merges first
                v, until = beside[v], nv
                if lost(u << 32 | v, -1) == until:
                    return False

    def follows(self, u: int, v: int) -> bool:
        if len(self.arcs) > 2 * REMEMBERED:
            self.arcs.clear()
        known = self.arcs[u << 32 | v] = self.arc(u, v)
        return known

    def read_labels(self) -> None:
        """The byte table: steps by node and byte, failure arcs, the longest label that ends at a node, and by label the longest of the
        shorter ones that end with it."""
        steps, fail, ends, depth_of = {}, [0], [-1], [0]
        for word, token in self.whole.items():
            node = 0
            for byte in word:
                to = steps.get(node << 8 | byte)
                if to is None:
                    to = steps[node << 8 | byte] = len(fail)
                    fail.append(0)
                    ends.append(-1)
                    depth_of.append(depth_of[node] + 1)
                node = to
            ends[node] = token
        self.shorter = [-1] * len(self.made)
        self.size = [len(self.label.get(i, b"")) for i in range(len(self.made))]
        for key, node in sorted(steps.items(), key=lambda s: depth_of[s[1]]):
            before, byte = key >> 8, key & 255
            if before:
                at = fail[before]
                while (to := steps.get(at << 8 | byte)) is None and at:
                    at = fail[at]
                fail[node] = to or 0
            longest = ends[fail[node]]
            if ends[node] < 0:
                ends[node] = longest
            else:
                self.shorter[ends[node]] = longest
        self.steps, self.fail, self.ends = steps, fail, ends

    def path(self, word: bytes) -> tuple[int, ...]:
        """The labels of the accepted path that spells the word."""
        if (one := self.whole.get(word)) is not None:
            return (one,)
        steps, fail, ends, shorter, size, known, follows = self.steps.get, self.fail, self.ends, self.shorter, self.size, self.arcs.get, self.follows
        node, last, at = 0, [-1], 0
        for byte in word:
            at += 1
            while (to := steps(node << 8 | byte)) is None:
                node = fail[node]
            node = to
            token = ends[node]
            while (before := at - size[token]) > 0:
                u = last[before]
                there = known(u << 32 | token)
                if there is None:
                    there = follows(u, token)
                if there:
                    break
                token = shorter[token]
            last.append(token)
        out = []
        while at:
            out.append(last[at])
            at -= size[last[at]]
        return tuple(out[::-1])

    def pieces(self, text: str) -> Iterator[str]:
        """Parts of the text that are split into words apart: a space between two letters begins a word in any case."""
        at = 0
        while len(text) - at > PIECE:
            cut = at + PIECE
            while cut < len(text) - 1 and not (text[cut] == " " and text[cut - 1].isalpha() and text[cut + 1].isalpha() and text[cut + 1].isascii()):
                cut += 1
            if cut >= len(text) - 1:
                break
            yield text[at:cut]
            at = cut
        yield text[at:] if at else text

    def encoded(self, text: str) -> Iterator[list[int]]:
        """The ids, in runs."""
        path_of = self.paths.__getitem__
        parts = [(text, None)]
        if self.specials and (marks := list(self.specials.finditer(text))):
            starts = [0, *(m.end() for m in marks)]
            parts = [(text[a:m.start()], self.special[m[0]]) for a, m in zip(starts, marks)] + [(text[starts[-1] :], None)]
        for part, mark in parts:
            for piece in self.pieces(part):
                yield list(chain.from_iterable(map(path_of, self.split(piece))))
            if mark is not None:
                yield [mark]

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(self.encoded(text or "")))

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.label.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


def automaton(spec: str) -> Automaton:
    """One for each worker process."""
    return kept(("automaton", hashlib.sha256(spec.encode()).hexdigest()), lambda: Automaton(spec))


def with_automaton(df: DataFrame, path: str, schema: str, row: Callable) -> DataFrame:
    """Maps (key, value) rows through row(automaton, value). The vocabulary file is read by the driver and broadcast (it is a
    fixed 1.6 MB), so executors need no copy of it."""
    with open(path, encoding="utf-8") as f:
        spec = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, fields = automaton(spec.value), None
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = [row(machine, x.as_py()) for x in part.column(1)]
                columns = list(zip(*rows)) if rows else [()]
                fields = fields or out
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(columns, fields))], [df_key, *names])

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    kinds = _parse_datatype_string(schema)
    arrow = to_arrow_schema(kinds)
    names, out, df_key = [f.name for f in kinds], [f.type for f in arrow], df.columns[0]
    return df.mapInArrow(run, StructType([df.schema[0], *kinds.fields]))


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids."""
    return with_automaton(spread(docs.select("doc_id", "text")), path, "ids array<int>", lambda m, text: (m.encode(text),))


def _encoded_and_decoded(machine: Automaton, text: str | None) -> tuple[list[int], str]:
    ids = machine.encode(text)
    return ids, hashlib.sha256(machine.decode(ids).encode()).hexdigest()


def encode_and_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, decoded_sha256: encoded, and the digest of the text that the ids decode to, in one pass."""
    return with_automaton(spread(docs.select("doc_id", "text")), path, "ids array<int>, decoded_sha256 string", _encoded_and_decoded)


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text, from doc_id, ids."""
    return with_automaton(encoded.select("doc_id", "ids"), path, "text string", lambda m, ids: (m.decode(ids or []),))


def _digests(machine: Automaton, text: str | None) -> tuple[int, str, str]:
    ids_sha, text_sha, n, names = hashlib.sha256(), hashlib.sha256(), 0, machine.names.__getitem__
    held = b""
    for ids in machine.encoded(text or ""):
        if ids:
            ids_sha.update((("," if n else "") + ",".join(map(names, ids))).encode())
            n += len(ids)
            held += machine.decode_bytes(ids)
            whole = held.decode("utf-8", "ignore").encode() if held[-1] >= 0x80 else held
            if held.startswith(whole) and len(held) - len(whole) < 4:
                text_sha.update(whole)
                held = held[len(whole) :]
    text_sha.update(held.decode("utf-8", "replace").encode())
    return n, ids_sha.hexdigest(), text_sha.hexdigest()


def token_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoded, and decoded again from the ids, in one pass."""
    return with_automaton(spread(docs.select("doc_id", "text")), path, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", _digests)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
