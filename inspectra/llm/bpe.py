"""BPE encoding and decoding over a trie of distinct words.

A vocabulary file of the ``tokenizers`` library (BPE with word ends, no
decoder) is read from a path given as a parameter. Encoding a text:

1. its special tokens are cut out, the rest is brought to NFC and lower case
   and split into words, each a string of byte characters;
2. the distinct words of a batch that aren't known yet are inserted into a
   trie, which is walked depth-first. The state of a node is the last token of
   the encoding of its prefix. The last token of a longer prefix is the one
   token that ends there and is compatible with the state of the node where it
   begins: merging the two by the rules leaves them apart. So the encoding of
   a prefix that many words share is worked out once;
3. a word's ids are read off its path backwards.

The tokens that end at a node come from an automaton over all tokens. Sorted
words are the trie in depth-first order: only the states on the path to the
current node are held. What is known of the pieces between white space stays
in dictionaries of bounded size, and is forgotten when a task ends: a worker that
Spark keeps for later steps holds the tables of the vocabulary alone.

Decoding joins token strings by one space, as the library does for a file
without a decoder.

Defined cases: null counts as empty; an empty text has no ids and decodes to
the empty text; rows that repeat are encoded alike; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import struct
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD_END = "</w>"
KNOWN_CHUNKS = 100_000
ROWS_OUT = 256

#: White space, and what a word is, as the vocabulary file defines it.
_SPACE = r"\t-\r \x85   -     　"
_SPACES = regex.compile(f"[{_SPACE}]+")
_CONTROL = regex.compile(r"[\x1c-\x1f]")
_WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where it is
    printable Latin-1, else the next free one from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class Encoder:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocabulary: dict[str, int] = spec["model"]["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.rank = {(vocabulary[a], vocabulary[b]): (i, vocabulary[a + b]) for i, (a, b) in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text_of = {i: s for s, i in (vocabulary | self.special).items()}
        self.vocabulary = vocabulary
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.bytes_to_text = dict(enumerate(byte_characters()))
        self.symbols_of = {i: self._symbols(s) for s, i in vocabulary.items()}
        #: Tokens that the merges give for their own symbols, inside a word and at its end.
        self.inner: dict[str, int] = {}
        self.final: dict[str, int] = {}
        for s, i in vocabulary.items():
            if self.merged(self.symbols_of[i]) == [i]:
                if s.endswith(WORD_END) and s != WORD_END:
                    self.final[s.removesuffix(WORD_END)] = i
                else:
                    self.inner[s] = i
        self.longest = max(map(len, [*self.inner, *self.final]))
        self.forget()
        self.build()

    def forget(self) -> None:
        """Only the special tokens stay known."""
        self.known: dict[str, tuple[bytes, bytes]] = {s: (struct.pack("<I", i), s.encode()) for s, i in self.special.items()}
        self.older: dict[str, tuple[bytes, bytes]] = {}
        self.apart: dict[int, bool] = {}

    def _symbols(self, token: str) -> list[int]:
        end = WORD_END if token.endswith(WORD_END) and token != WORD_END else ""
        body = token.removesuffix(end)
        return [self.vocabulary[c + (end if k == len(body) - 1 else "")] for k, c in enumerate(body)]

    def merged(self, ids: list[int]) -> list[int]:
        """The merge rules applied in order of rank, leftmost first."""
        ids = list(ids)
        while len(ids) > 1:
            pairs = [(self.rank[p], k) for k, p in enumerate(zip(ids, ids[1:], strict=False)) if p in self.rank]
            if not pairs:
                break
            (_, new), k = min(pairs)
            ids[k : k + 2] = [new]
        return ids

    def compatible(self, left: int, right: int) -> bool:
        key = left << 20 | right
        known = self.apart.get(key)
        if known is None:
            known = self.apart[key] = self.merged(self.symbols_of[left] + self.symbols_of[right]) == [left, right]
        return known

    def words(self, text: str) -> list[str]:
        """The words of a piece of text that is normalised."""
        return _WORDS.findall(text)

    def chunks(self, text: str) -> list[str]:
        """The text, normalised and split at white space; its special tokens
        stay as they are. No word spans white space."""
        if self.cut is not None and "<|" in text:
            out: list[str] = []
            for k, part in enumerate(self.cut.split(text)):
                out += [part] if k % 2 else self._chunks(part)
            return out
        return self._chunks(text)

    def _chunks(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # lower() would look at the neighbours of a sigma
                text = text.replace("Σ", "σ")
        text = text.lower()
        if _CONTROL.search(text):  # white space to str.split, not to the vocabulary file
            return [c for c in _SPACES.split(text) if c]
        return text.split()

    def learn(self, chunks: set[str]) -> None:
        """Have (ids, decoded) of each chunk in ``known``. Two generations: what
        the older one still knows moves to the younger when it is met again."""
        if len(self.known) > KNOWN_CHUNKS:
            older, apart = self.known, self.apart
            self.forget()
            self.older, self.apart = older, apart
        new = chunks - self.known.keys()
        for c in new & self.older.keys():
            self.known[c] = self.older[c]
        new -= self.known.keys()
        split = {c: [c] if c.isalpha() else self.words(c) for c in new}
        table, spelled = self.bytes_to_text, {}
        for w in set().union(*split.values()):
            spelled[w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(table)] = w
        found = {}
        text_of = self.text_of
        for word, ids in self.walk(sorted(spelled)):
            found[spelled[word]] = (struct.pack(f"<{len(ids)}I", *ids), " ".join([text_of[i] for i in ids]).encode())
        for c, words in split.items():
            self.known[c] = found[c] if len(words) == 1 and words[0] == c else (b"".join([found[w][0] for w in words]), b" ".join([found[w][1] for w in words]))

    def follow(self, at: int, symbol: str) -> int:
        """The automaton of the inner tokens: the longest prefix of a token that
        ends with the symbol. Missing steps are added when first taken."""
        up = at
        while symbol not in self.step[up] and up:
            up = self.up[up]
        to = self.step[up].get(symbol, 0)
        self.step[at][symbol] = to
        return to

    def build(self) -> None:
        """Nodes for all prefixes of inner tokens; ends[n]: the inner tokens
        that end at node n and their lengths, longest first."""
        self.step, self.up, own = [{}], [0], [None]
        for token, i in self.inner.items():
            at = 0
            for c in token:
                to = self.step[at].get(c)
                if to is None:
                    to = self.step[at][c] = len(self.step)
                    self.step.append({})
                    self.up.append(0)
                    own.append(None)
                at = to
            own[at] = (i, len(token))
        self.ends: list[tuple] = [()] * len(self.step)
        level = [(0, c, n) for c, n in self.step[0].items()]
        children = [list(s.items()) for s in self.step]
        while level:
            below = []
            for parent, c, n in level:
                if parent:
                    up = self.up[parent]
                    while up and c not in self.step[up]:
                        up = self.up[up]
                    self.up[n] = self.step[up].get(c, 0)
                self.ends[n] = ((own[n],) if own[n] else ()) + self.ends[self.up[n]]
                below += [(n, d, m) for d, m in children[n]]
            level = below

    def walk(self, words: list[str]) -> Iterator[tuple[str, list[int]]]:
        """Ids of sorted words. Of each prefix on the path to the current node:
        its last token, where that begins, and its node of the automaton."""
        final, apart, longest, step, ends, before = self.final, self.apart, self.longest, self.step, self.ends, ""
        last, start, node = [-1], [0], [0]
        for word in words:
            size, shared = len(word), 0
            most = min(len(last) - 1, size - 1)
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :], start[shared + 1 :], node[shared + 1 :]
            at = node[shared]
            for end in range(shared + 1, size):
                symbol = word[end - 1]
                to = step[at].get(symbol)
                at = self.follow(at, symbol) if to is None else to
                for token, length in ends[at]:
                    begin = end - length
                    if begin:
                        key = last[begin] << 20 | token
                        fits = apart.get(key)
                        if not (self.compatible(last[begin], token) if fits is None else fits):
                            continue
                    break
                else:
                    raise ValueError(f"no token ends at {end} of {word!r}")
                last.append(token)
                start.append(begin)
                node.append(at)
            for begin in range(max(0, size - longest), size):
                token = final.get(word[begin:])
                if token is not None and (not begin or self.compatible(last[begin], token)):
                    break
            else:
                raise ValueError(f"no token ends {word!r}")
            ids = [token]
            while begin:
                ids.append(last[begin])
                begin = start[begin]
            ids.reverse()
            before = word
            yield word, ids

    def encode_batch(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """(ids as little-endian unsigned 32-bit integers, decoded text) of each."""
        split = [self.chunks(t) for t in texts]
        self.learn(set().union(*split))
        out, known = [], self.known
        for chunks in split:
            if not chunks:
                out.append((b"", b""))
                continue
            ids, decoded = zip(*map(known.__getitem__, chunks), strict=True)
            out.append((b"".join(ids), b" ".join(decoded)))
        return out

    def decode(self, ids: bytes) -> str:
        return " ".join(self.text_of[i] for (i,) in struct.iter_unpack("<I", ids))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per Python worker and vocabulary."""
    return Encoder(path)


def encoded_batches(batches: Iterator[pd.DataFrame], path: str) -> Iterator[pd.DataFrame]:
    """What one task makes of its rows."""
    known = encoder(path)
    try:
        for batch in batches:
            for k in range(0, len(batch), ROWS_OUT):
                part = batch.iloc[k : k + ROWS_OUT]
                pairs = known.encode_batch(part["text"].tolist())
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "ids": [p[0] for p in pairs], "decoded": [p[1].decode() for p in pairs]})
    finally:
        known.forget()


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit), decoded (string)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return encoded_batches(batches, path)

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInPandas(run, "doc_id long, ids binary, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    size: Column = (F.octet_length("ids") / 4).cast("long")
    return encoded.select("doc_id", size.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
