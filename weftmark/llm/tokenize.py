"""Encoding of a corpus with a public byte-level BPE vocabulary, as a lazily determinised transducer.

A token sequence is the BPE encoding of its bytes exactly if every two neighbours are compatible, that is,
if merging never joins across their border. So all encodings form a finite-state machine: states are a
last token and a place in the token trie. Read left to right it is nondeterministic; here it is
determinised while it runs. A deterministic state is a set of hypotheses (last token, trie node), one for each
place where a token may have begun. As every prefix has one encoding, just one hypothesis may end at each byte;
the machine writes the token that ends so, and the tokens of a pre-token are read off from its end. States and
transitions are made when first met and kept in tables of bounded size, of plain integers, which cost the garbage
collector nothing.

A whole pre-token's result is kept too, in a table of bounded size: words repeat. Emptying either table
changes no result.
"""

from __future__ import annotations

import base64
import os
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER_DIR = os.environ.get("WEFTMARK_TOKENIZERS", "/opt/tokenizers")
# Fixed value: the published pre-token pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MAX_STATES, MAX_WORDS = 100_000, 200_000


class Transducer:
    """Encoder and decoder of one vocabulary of (token bytes, rank) lines."""

    def __init__(self, vocabulary: bytes, pattern: str = PATTERN):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}
        self.tokens = {i: t for t, i in self.ranks.items()}
        if len(self.tokens) != len(self.ranks) or any(bytes([b]) not in self.ranks for b in range(256)):
            raise ValueError("a vocabulary needs distinct ranks and all 256 single bytes")
        self.width = max(self.tokens) + 1
        self._split_pattern = regex.compile(pattern)
        self._child: dict[int, int] = {}  # trie: node * 256 + byte -> node
        self._ends = [-1]  # token of a node, or -1
        for token, rank in self.ranks.items():
            node = 0
            for byte in token:
                key = node * 256 + byte
                node = self._child.get(key)
                if node is None:
                    node = self._child[key] = len(self._ends)
                    self._ends.append(-1)
            self._ends[node] = rank
        self._parts: dict[int, tuple[int, int] | None] = {}
        self._fits: dict[int, bool] = {}
        self._words: dict[str, bytes] = {}
        self._clear()

    # compatibility of neighbours

    def parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; None for a single byte."""
        found = self._parts.get(token, False)
        if found is False:
            word = self.tokens[token]
            pieces = [word[i : i + 1] for i in range(len(word))]
            while len(pieces) > 2:
                best = min(range(len(pieces) - 1), key=lambda i: self._rank_below(pieces[i] + pieces[i + 1], token))
                if self._rank_below(pieces[best] + pieces[best + 1], token) == self.width:
                    raise ValueError(f"token {token} is not made by merges of the vocabulary")
                pieces[best : best + 2] = [pieces[best] + pieces[best + 1]]
            found = self._parts[token] = (self.ranks[pieces[0]], self.ranks[pieces[1]]) if len(pieces) == 2 else None
        return found

    def _rank_below(self, word: bytes, limit: int) -> int:
        rank = self.ranks.get(word, self.width)
        return rank if rank < limit else self.width

    def fits(self, left: int, right: int) -> bool:
        """Whether the encoding of the bytes of both is just these two tokens."""
        key = left * self.width + right
        found = self._fits.get(key)
        if found is None:
            if len(self._fits) > 2_000_000:
                self._fits.clear()
            found = self._fits[key] = self._border_holds(left, right)
        return found

    def _border_holds(self, left: int, right: int) -> bool:
        """No merge joins a suffix of ``left`` with a prefix of ``right`` before both are complete.

        Walks back through the tokens (a, b) that met at the border, latest first. ``until_a`` is the rank of
        the merge that swallowed a, likewise for b. The two would have merged if the rank of their union comes
        before both; at equal rank the left place is merged first.
        """
        tokens, rank_of, known = self.tokens, self.ranks.get, self._parts
        a, b = left, right
        until_a = until_b = width = self.width
        of_a = known[a] if a in known else self.parts(a)
        of_b = known[b] if b in known else self.parts(b)
        while True:
            rank = rank_of(tokens[a] + tokens[b], width)
            if rank < until_a and rank <= until_b:
                return False
            if of_b is not None and (of_a is None or b >= a):
                until_b, b = b, of_b[0]
                of_b = known[b] if b in known else self.parts(b)
            elif of_a is not None:
                until_a, a = a, of_a[1]
                of_a = known[a] if a in known else self.parts(a)
            else:
                return True

    # the machine

    def _clear(self) -> None:
        self._ids: dict[tuple[int, ...], int] = {}
        self._states: list[tuple[int, ...]] = []  # last token, trie node, last token, trie node, ...; the longest open token first
        self._moves: dict[int, int] = {}  # state * 256 + byte -> state; the token that ends is the state's last but one number
        self._intern((-1, 0))

    def _intern(self, state: tuple[int, ...]) -> int:
        found = self._ids.get(state)
        if found is None:
            found = self._ids[state] = len(self._states)
            self._states.append(state)
        return found

    def _move(self, at: int, byte: int) -> int:
        child, ends, fits, width, out, ended = self._child.get, self._ends, self._fits.get, self.width, [], -1
        pairs = iter(self._states[at])
        for last, node in zip(pairs, pairs):
            onward = child(node * 256 + byte)
            if onward is not None:
                out += (last, onward)
                if ended < 0:
                    token = ends[onward]
                    if token >= 0:
                        if node == 0 or last < 0:  # the byte alone comes last, and one of the hypotheses ends here
                            ended = token
                        else:
                            fit = fits(last * width + token)
                            if self.fits(last, token) if fit is None else fit:
                                ended = token
        out += (ended, 0)
        result = self._moves[at * 256 + byte] = self._intern(tuple(out))
        return result

    def encode_bytes(self, word: bytes) -> list[int]:
        """Token ids of one pre-token."""
        moves, states, at, passed, ended = self._moves, self._states, 0, [], []
        for byte in word:
            move = moves.get(at * 256 + byte)
            if move is None:
                if len(states) > MAX_STATES:  # start the table anew from where we are
                    ended += [states[i][-2] for i in passed]
                    passed, here = [], states[at]
                    self._clear()
                    moves, states, at = self._moves, self._states, self._intern(here)
                move = self._move(at, byte)
            at = move
            passed.append(at)
        ended += [states[i][-2] for i in passed]
        tokens, out, end = self.tokens, [], len(ended)
        while end:
            token = ended[end - 1]
            out.append(token)
            end -= len(tokens[token])
        out.reverse()
        return out

    def _encode_word(self, word: str) -> bytes:
        """Ids of one pre-token as 32-bit integers."""
        words = self._words
        ids = words.get(word)
        if ids is None:
            ids = array("i", self.encode_bytes(word.encode())).tobytes()
            if len(word) <= 64:
                if len(words) > MAX_WORDS:
                    words.clear()
                words[word] = ids
        return ids

    def encode_into(self, text: str, out: array) -> None:
        """Append the ids of a text. Text that looks like a special token is ordinary text."""
        found = self._split_pattern.findall(text)
        ids = [*map(self._words.get, found)]
        if None in ids:
            ids = [self._encode_word(word) if known is None else known for word, known in zip(found, ids)]
        out.frombytes(b"".join(ids))

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; none for null or empty text."""
        out = array("i")
        if text:
            self.encode_into(text, out)
        return list(out)

    def decode(self, ids) -> str:
        """Text of the ids; bytes that are no UTF-8 become U+FFFD."""
        machine = Utf8Machine()
        return "".join([*(machine.feed(self.tokens[i]) for i in ids), machine.end()])


class Utf8Machine:
    """Incremental UTF-8 decoder: its state is the open sequence and what its next byte may be."""

    def __init__(self) -> None:
        self.point, self.left, self.low, self.high = 0, 0, 0x80, 0xBF

    def feed(self, data: bytes) -> str:
        out = []
        for byte in data:
            if self.left:
                if self.low <= byte <= self.high:
                    self.point = self.point << 6 | byte & 0x3F
                    self.left -= 1
                    self.low, self.high = 0x80, 0xBF
                    if not self.left:
                        out.append(chr(self.point))
                    continue
                out.append("�")
                self.left = 0
            self.low, self.high = 0x80, 0xBF
            if byte < 0x80:
                out.append(chr(byte))
            elif 0xC2 <= byte <= 0xDF:
                self.point, self.left = byte & 0x1F, 1
            elif 0xE0 <= byte <= 0xEF:
                self.point, self.left = byte & 0x0F, 2
                self.low, self.high = 0xA0 if byte == 0xE0 else 0x80, 0x9F if byte == 0xED else 0xBF
            elif 0xF0 <= byte <= 0xF4:
                self.point, self.left = byte & 0x07, 3
                self.low, self.high = 0x90 if byte == 0xF0 else 0x80, 0x8F if byte == 0xF4 else 0xBF
            else:
                out.append("�")
        return "".join(out)

    def end(self) -> str:
        """What is due at the end of input: one U+FFFD for an unfinished sequence."""
        left, self.left = self.left, 0
        return "�" if left else ""


_compiled: dict[int, Transducer] = {}


def transducer(vocabulary: bytes) -> Transducer:
    """The machine of a vocabulary, compiled once in each worker process."""
    key = hash(vocabulary)
    if key not in _compiled:
        _compiled.clear()
        _compiled[key] = Transducer(vocabulary)
    return _compiled[key]


def read_vocabulary(name: str = "byte_bpe_50k", folder: str | None = None) -> bytes:
    """The rank file of a public vocabulary."""
    with open(os.path.join(folder or TOKENIZER_DIR, f"{name}.tiktoken"), "rb") as f:
        return f.read()


def encode_texts(df: DataFrame, key: str, text: str = "text", vocabulary: bytes | None = None, counts_only: bool = False) -> DataFrame:
    """(key, ids ARRAY<INT>), or (key, n_tokens BIGINT) with ``counts_only``, of every row.

    Null and empty texts give an empty array, or 0. The vocabulary (under 1 MB, whatever the corpus) is the
    only broadcast. Rows stand alone: no shuffle, and Arrow batches carry flat id buffers.
    """
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(vocabulary or read_vocabulary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(shared.value)
        for batch in batches:
            flat, ends = array("i"), array("i", [0])
            for value in batch.column(1):
                text_ = value.as_py()
                if text_:
                    machine.encode_into(text_, flat)
                ends.append(len(flat))
            if counts_only:
                n = pa.array([b - a for a, b in zip(ends, ends[1:])], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), n], ["key", "n_tokens"])
            else:
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.Array.from_buffers(pa.int32(), len(flat), [None, pa.py_buffer(flat)]))
                yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["key", "ids"])

    out = f"key {kind}, " + ("n_tokens bigint" if counts_only else "ids array<int>")
    return rows.mapInArrow(run, out).withColumnRenamed("key", key)


def decode_ids(df: DataFrame, key: str, ids: str = "ids", vocabulary: bytes | None = None) -> DataFrame:
    """(key, text) of id arrays; an empty array gives empty text, a null array null."""
    rows = df.select(F.col(key).alias("key"), F.col(ids).alias("ids"))
    kind = rows.schema["key"].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(vocabulary or read_vocabulary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(shared.value)
        for batch in batches:
            texts = pa.array([None if x is None else machine.decode(x) for x in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], ["key", "text"])

    return rows.mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)
