"""BPE encoding by backtracking over Aho-Corasick longest matches, and decoding by an offset table.

A word is encoded left to right with the longest token that fits; a token may follow
another only if the pair is one that merging itself would leave apart, which a table of
the merges decides.  Where nothing fits, the last token is taken back and a shorter prefix
of it is tried; a position that has failed once is not tried again, so the work is linear
in the word.  The result is exactly that of applying the merges in order.

Atoms are bytes, the last one of a word marked: the vocabulary's tokens that end a word
(``</w>``) are strings whose last atom is marked.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F, types as T

from lakefinder.llm.arrow import tidy

#: Added to the code point of a word's last atom.
LAST = 0x1000
NO_TOKEN = -1
#: About how many bytes of words with their ids, and how many pairs, a worker remembers; beyond that it forgets them and starts anew.
REMEMBERED_BYTES, REMEMBERED_PAIRS = 12 << 20, 100_000
#: Words of more characters are not remembered, and what a remembered one takes besides its characters and ids.
LONGEST, ENTRY = 40, 180


def byte_characters() -> dict[str, int]:
    """The public byte-level alphabet: printable Latin-1 characters stand for themselves, other bytes follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(c): b for c, b in [*zip(plain, plain, strict=True), *((256 + k, b) for k, b in enumerate(rest))]}


class Tables:
    """What encoding needs of a vocabulary: plain data, to be broadcast once."""

    def __init__(self, model: dict, suffix: str):
        """model: ``vocab`` (token to id) and ``merges`` (pairs in order); suffix: the mark of a word's end."""
        vocab, chars = model["vocab"], byte_characters()

        def atoms(token: str) -> str:
            end = token.endswith(suffix) and token != suffix
            out = [chr(chars[c]) for c in (token[: -len(suffix)] if end else token)]
            if end:
                out[-1] = chr(LAST + ord(out[-1]))
            return "".join(out)

        # rank tokens as merging does: single atoms first, then in the order of their merges
        merges = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        made = {a + b for a, b in merges}
        single = [t for t in vocab if t not in made]
        self.ids, self.atoms, self.left, self.right = [], [], [], []
        rank: dict[str, int] = {}
        for t in single:
            try:
                at = atoms(t)
            except KeyError:
                continue  # a special token: not made of bytes
            if len(at) != 1:
                continue
            rank[t] = len(self.ids)
            self.ids.append(vocab[t])
            self.atoms.append(at)
            self.left.append(rank[t])
            self.right.append(rank[t])
        self.pairs: dict[int, int] = {}
        for a, b in merges:
            t = a + b
            if t in rank or a not in rank or b not in rank:
                raise ValueError(f"a token has two merges, or parts that come later: {a!r} {b!r}")
            rank[t] = len(self.ids)
            self.pairs[rank[a] << 32 | rank[b]] = rank[t]
            self.ids.append(vocab[t])
            self.atoms.append(atoms(t))
            self.left.append(rank[a])
            self.right.append(rank[b])

    def compatible(self, one: int, two: int) -> bool:
        """Whether merging leaves the tokens apart when they stand side by side.

        Undoes the later of the two along the seam, step by step; a merge across the seam
        that comes before the one undone last would have happened first.
        """
        limit = 1 << 60
        while True:
            across = self.pairs.get(one << 32 | two)
            if across is not None and across < limit:
                return False
            if one > two:
                limit, one = one, self.right[one]
                if one != limit:
                    continue
                limit, two = two + 1, self.left[two]
                if two + 1 == limit:
                    return True
            else:
                limit, two = two + 1, self.left[two]
                if two + 1 != limit:
                    continue
                limit, one = one, self.right[one]
                if one == limit:
                    return True


class Encoder:
    """Encodes words; one for each worker, as its automaton is built from ``Tables`` where it is used."""

    def __init__(self, tables: Tables):
        self.t = tables
        self.length = list(map(len, tables.atoms))
        # matches of reversed tokens that end at a place of the reversed word are the tokens that begin there
        self.back = ahocorasick.Automaton()
        for r, a in enumerate(tables.atoms):
            self.back.add_word(a[::-1], r)
        self.back.make_automaton()
        number = {a: r for r, a in enumerate(tables.atoms)}
        self.shorter = [next((number[a[:n]] for n in range(len(a) - 1, 0, -1) if a[:n] in number), NO_TOKEN) for a in tables.atoms]
        self.seen: dict[int, bool] = {}

    def fits(self, one: int, two: int) -> bool:
        pair = one << 32 | two
        found = self.seen.get(pair)
        if found is None:
            if len(self.seen) >= REMEMBERED_PAIRS:
                self.seen.clear()
            found = self.seen[pair] = self.t.compatible(one, two)
        return found

    def encode(self, word: bytes) -> list[int]:
        """The ids of a word."""
        if not word:
            return []
        text = word[:-1].decode("latin-1") + chr(LAST + word[-1])
        n = len(text)
        longest = [NO_TOKEN] * (n + 1)
        for end, r in self.back.iter(text[::-1]):
            start = n - 1 - end
            if longest[start] == NO_TOKEN or self.length[r] > self.length[longest[start]]:
                longest[start] = r
        usable = [True] * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            if token == NO_TOKEN:  # nothing fits here: take the last token back
                if not out:
                    raise ValueError("the vocabulary lacks a byte")
                usable[at] = False
                token = out.pop()
                at -= self.length[token]
                token = self.shorter[token]
                continue
            end = at + self.length[token]
            if usable[end] and (not out or self.fits(out[-1], token)):
                out.append(token)
                at, token = end, longest[end]
            else:
                token = self.shorter[token]
        ids = self.t.ids
        return [ids[r] for r in out]


class Memory:
    """Words and their ids, of about ``REMEMBERED_BYTES`` at most."""

    def __init__(self, encode):
        self.encode, self.known, self.size = encode, {}, 0

    def __call__(self, word: str) -> bytes:
        found = self.known.get(word)
        if found is None:
            found = np.array(self.encode(word), "<u4").tobytes()
            if len(word) <= LONGEST:
                self.size += ENTRY + len(word) + len(found)
                if self.size > REMEMBERED_BYTES:
                    self.known.clear()
                    self.size = ENTRY + len(word) + len(found)
                self.known[word] = found
        return found


#: Letters that need no normalising but lower-casing, and what else may stand in a text that takes the short way.
LETTERS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-įĲ-ňŊ-ž"
PLAIN = re.compile(f"[\t\n\r !-~\xa1-\xa9\xab-\xac\xae-\xb1\xb4\xb6-\xb8\xbb\xbf\xd7\xf7{LETTERS}]*")
LOWER_LETTERS = "a-z\xdf-\xf6\xf8-ž"
#: The pattern of the vocabulary file, for plain texts.
PRETOKEN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LOWER_LETTERS}]+|[0-9]|[^\\s0-9{LOWER_LETTERS}]+")


class TextEncoder:
    """Whole texts to ids, as the file's normaliser and pre-tokeniser cut them into words."""

    def __init__(self, tables: Tables, spec: str, special: dict[str, int]):
        from tokenizers import Tokenizer

        whole = Tokenizer.from_str(spec)
        self.normalise, self.cut = whole.normalizer, whole.pre_tokenizer
        self.encoder, self.chars = Encoder(tables), byte_characters()
        self.special = {t: np.array([i], "<u4").tobytes() for t, i in special.items()}
        self.around = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.plain = Memory(lambda w: self.encoder.encode(w.encode()))
        self.other = Memory(lambda w: self.encoder.encode(bytes(self.chars[c] for c in w)))

    def _plain(self, text: str) -> Iterator[bytes]:
        return map(self.plain, PRETOKEN.findall(text.lower()))

    def _any(self, text: str) -> Iterator[bytes]:
        """Other texts go through the library's own normaliser and pre-tokeniser; the merges are ours."""
        return (self.other(w) for w, _ in self.cut.pre_tokenize_str(self.normalise.normalize_str(text)))

    def encode(self, text: str | None) -> np.ndarray:
        out: list[bytes] = []
        for part in self.around.split(text or "") if self.around else [text or ""]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out += self._plain(part) if PLAIN.fullmatch(part) else self._any(part)
        return np.frombuffer(b"".join(out), "<u4")


class Decoder:
    """Ids to text: each token's bytes lie at an offset of one buffer; tokens are joined by a blank."""

    def __init__(self, vocab: dict[str, int]):
        size = max(vocab.values()) + 1
        token = [b""] * size
        for t, i in vocab.items():
            token[i] = t.encode() + b" "
        self.start = np.cumsum([0, *map(len, token)])
        self.bytes = np.frombuffer(b"".join(token), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        if not len(ids):
            return b""
        first = self.start[ids]
        n = self.start[ids.astype(np.int64) + 1] - first
        ends = np.cumsum(n)
        return self.bytes[np.repeat(first - ends + n, n) + np.arange(ends[-1])].tobytes()[:-1]


def load(path: str) -> tuple[Tables, str, dict[str, int], dict[str, int]]:
    """Tables, the file without its model, special tokens and the whole vocabulary, of a tokenizers file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    tables = Tables(model, model["end_of_word_suffix"])
    rest = spec | {"model": {"type": "BPE", "vocab": {}, "merges": []}, "added_tokens": [], "truncation": None, "padding": None}
    return tables, json.dumps(rest), special, model["vocab"] | special


#: The encoder and decoder of this process, by the digest of their file: workers outlive tasks, and building takes a second.
_made: dict[str, tuple[TextEncoder, Decoder]] = {}


def coders(shared: Broadcast, name: str) -> tuple[TextEncoder, Decoder]:
    if name not in _made:
        _made.clear()
        tables, spec, special, vocab = shared.value
        _made[name] = TextEncoder(tables, spec, special), Decoder(vocab)
    return _made[name]


def digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def encode_documents(docs: DataFrame, path: str, text_col: str = "text", decoded: bool = False, digests: bool = False, counts: bool = False) -> DataFrame:
    """Add to ``docs`` (without its text) the ids of the text, or their digests.

    path: a tokenizers file with a BPE model of bytes whose words end in a suffix, readable on
    the driver; its tables (a vocabulary, of a fixed size) are broadcast.  Adds ``n_tokens``,
    and ``ids`` (array<int>) or, with ``digests``, ``ids_sha256`` and ``decoded_sha256``
    (SHA-256 of the ids as little-endian 32-bit integers and of the decoded text); with
    ``counts`` ``n_tokens`` alone; with ``decoded`` also the text ``decoded``.

    Special tokens' strings in a text are encoded as those tokens.  A null or empty text has
    no ids and decodes to the empty text.  Repeated rows are encoded singly.  A column that
    has the name of an added one is replaced.
    """
    added = {"n_tokens": ("long", pa.int64())}
    if digests:
        added |= {"ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())}
    elif not counts:
        added |= {"ids": ("array<int>", pa.list_(pa.int32()))}
    added |= {"decoded": ("string", pa.string())} if decoded else {}
    kept = [f for f in docs.schema if f.name != text_col and f.name not in added]
    schema = T.StructType([*kept, *T.StructType.fromDDL(", ".join([f"{k} {v[0]}" for k, v in added.items()]))])
    shared, name = docs.sparkSession.sparkContext.broadcast(load(path)), digest(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = coders(shared, name)
        for batch in batches:
            out: dict[str, list] = {k: [] for k in added}
            for text in batch.column(len(kept)):
                ids = encoder.encode(text.as_py())
                out["n_tokens"].append(len(ids))
                if digests:
                    out["ids_sha256"].append(hashlib.sha256(ids.tobytes()).hexdigest())
                    out["decoded_sha256"].append(hashlib.sha256(decoder.decode(ids)).hexdigest())
                elif not counts:
                    out["ids"].append(ids.astype(np.int32))
                if decoded:
                    out["decoded"].append(decoder.decode(ids).decode())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *(pa.array(out[k], t) for k, (_, t) in added.items())], [*(f.name for f in kept), *added])

    return docs.select(*(F.col(f"`{f.name}`") for f in kept), F.col(text_col).alias("__text")).mapInArrow(tidy(run), schema)


def decode_ids(rows: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """Replace the ids by the text they decode to, ``decoded`` (null ids: null; none: the empty text).

    Repeated rows are decoded singly, an empty table gives an empty result, and a column named
    ``decoded`` is replaced; others stay.
    """
    kept = [f for f in rows.schema if f.name not in (ids_col, "decoded")]
    schema = T.StructType([*kept, *T.StructType.fromDDL(", ".join(["decoded string"]))])
    shared = rows.sparkSession.sparkContext.broadcast(load(path)[3])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for batch in batches:
            texts = [None if x is None else decoder.decode(np.array(x, np.int64)).decode() for x in batch.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(texts, pa.string())], [*(f.name for f in kept), "decoded"])

    return rows.select(*(F.col(f"`{f.name}`") for f in kept), F.col(ids_col).alias("__ids")).mapInArrow(tidy(run), schema)
