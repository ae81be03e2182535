"""Byte-level BPE: whole texts to token ids and back.

The encoder never replays merges. An automaton over the vocabulary (bytes as Latin-1 characters) gives the longest token
at every byte. Tokens are then taken from left to right, longest first, and a token is kept only if it may follow the one
before it; if none fits, the encoder steps back. Two tokens may be neighbours exactly when merging their joined bytes by
rank would leave both whole, which one walk down their merge trees decides; the verdicts are remembered. Positions that
led nowhere are marked, so the work is linear in the bytes.
"""

from __future__ import annotations

import base64
import gc
from collections.abc import Callable
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from twinfold.llm.common import map_slices, pick

PART_CACHE = 120_000
PAIR_CACHE = 250_000
CACHED_PART_CHARS = 64
ENCODED_SCHEMA = "doc_id bigint, n_tokens bigint, ids binary"
DECODED_SCHEMA = "doc_id bigint, n_tokens bigint, ids binary, decoded binary"


def parse_ranks(content: bytes) -> list[bytes]:
    """Tokens in rank order from the lines ``base64 rank`` of a rank file."""
    ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, content.splitlines())}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must count up from 0 without gaps")
    return [ranks[i] for i in range(len(ranks))]


class _LongGap(Exception):
    """A part begins or ends with white space, or is empty."""


class _Remembered(dict):
    """Ids of space-free parts behind a fixed first character, in two generations of bounded size."""

    def __init__(self, encode: Callable[[str], bytes], before: str):
        super().__init__()
        self._encode, self._before, self._old = encode, before, {}

    def __missing__(self, part: str) -> bytes:
        ids = self._old.get(part)
        if ids is None:
            if not part or part[0].isspace() or part[-1].isspace():
                raise _LongGap
            ids = self._encode(self._before + part)
        if len(part) <= CACHED_PART_CHARS:
            if len(self) >= PART_CACHE:
                self._old = dict(self)
                self.clear()
            self[part] = ids
        return ids


class ByteBpe:
    """Encoder and decoder for one vocabulary of byte tokens in rank order."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens = tokens
        self.pattern = regex.compile(pattern)
        self.size = [len(t) for t in tokens]
        self._packed = [i.to_bytes(4, "little") for i in range(len(tokens))]
        self._rank = {t: i for i, t in enumerate(tokens)}
        if any(bytes([b]) not in self._rank for b in range(256)):
            raise ValueError("every single byte must be a token")
        self._shorter = [self._longest_part(t) for t in tokens]
        self._joined: dict[int, int] = {}
        self._halves: list[tuple[int, int]] = []
        self._fits: dict[int, bool] = {}
        self._grow_merges()
        self._matcher = ahocorasick.Automaton()
        for i, token in enumerate(tokens):
            self._matcher.add_word(token.decode("latin-1"), i)
        self._matcher.make_automaton()
        self._heads, self._tails = _Remembered(self.encode_part, ""), _Remembered(self.encode_part, " ")
        self._newline = self.encode_part("\n")

    def _longest_part(self, token: bytes) -> int:
        """Id of the longest proper prefix that is a token, or -1."""
        return next((self._rank[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in self._rank), -1)

    def _grow_merges(self) -> None:
        """The two halves whose merge makes each token, found in rank order."""
        for i, token in enumerate(self.tokens):
            self._halves.append((i, i))
            for cut in range(1, len(token)):
                left, right = self._rank.get(token[:cut], i), self._rank.get(token[cut:], i)
                if left < i and right < i and self._neighbours(left, right):
                    self._halves[i] = (left, right)
                    self._joined[left * len(self.tokens) + right] = i
                    break
            if len(token) > 1 and self._halves[i] == (i, i):
                raise ValueError(f"token {i} is no merge of two earlier tokens")

    def _neighbours(self, left: int, right: int) -> bool:
        """Whether merging by rank leaves ``left`` and ``right`` side by side, unmerged across the border.

        Undo the merges on both sides of the border, latest first. If at some moment the two innermost parts could have
        been merged earlier than the merges undone so far, they would have been.
        """
        width, undone = len(self.tokens), len(self.tokens)
        while True:
            if self._joined.get(left * width + right, undone) < undone:
                return False
            # on a tie in rank the merge further left comes first, so the right one is undone first
            if left > right:
                inner = self._halves[left][1]
                if inner != left:
                    undone, left = left, inner
                    continue
                inner = self._halves[right][0]
                if inner == right:
                    return True
                undone, right = right + 1, inner
            else:
                inner = self._halves[right][0]
                if inner != right:
                    undone, right = right + 1, inner
                    continue
                inner = self._halves[left][1]
                if inner == left:
                    return True
                undone, left = left, inner

    def encode_word(self, word: bytes) -> bytes:
        """Packed ids of one match of the pattern."""
        packed = self._packed
        whole = self._rank.get(word)
        if whole is not None:
            return packed[whole]
        end, size, shorter, fits, width = len(word), self.size, self._shorter, self._fits, len(self.tokens)
        longest = [0] * end
        for last, token in self._matcher.iter(word.decode("latin-1")):
            longest[last + 1 - size[token]] = token  # later matches from the same byte are longer
        dead: set[int] = set()
        chosen = [longest[0]]
        at = size[longest[0]]
        token = longest[at]
        while True:
            after = at + size[token]
            if after not in dead:
                if chosen:
                    key = chosen[-1] * width + token
                    fit = fits.get(key)
                    if fit is None:
                        if len(fits) >= PAIR_CACHE:
                            fits.clear()
                        fit = fits[key] = self._neighbours(chosen[-1], token)
                else:
                    fit = True
                if fit:
                    chosen.append(token)
                    if after == end:
                        return b"".join([packed[t] for t in chosen])
                    at, token = after, longest[after]
                    continue
            while shorter[token] < 0:  # nothing shorter starts here: step back to the token before
                dead.add(at)
                token = chosen.pop()
                at -= size[token]
            token = shorter[token]

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers.

        The pattern puts a single space at the head of what follows it and leaves a single line break alone, so a text
        can be cut there and the ids of its space-free parts can be remembered. Any other white space next to a cut
        makes longer runs that the pattern must see whole; such a text goes through the pattern undivided.
        """
        try:
            lines = []
            for line in text.split("\n"):
                first, *rest = line.split(" ")
                lines.append(self._heads[first] + b"".join(map(self._tails.__getitem__, rest)))
            return self._newline.join(lines)
        except _LongGap:
            return self.encode_part(text)

    def encode_part(self, text: str) -> bytes:
        return b"".join([self.encode_word(word.encode()) for word in self.pattern.findall(text)])


@lru_cache(maxsize=2)
def coder(ranks: bytes, pattern: str) -> ByteBpe:
    """One coder per worker process and vocabulary."""
    made = ByteBpe(parse_ranks(ranks), pattern)
    gc.freeze()  # its tables live as long as the process: spare the collector from walking them
    return made


@lru_cache(maxsize=2)
def vocabulary(ranks: bytes) -> list[bytes]:
    return parse_ranks(ranks)


def read_ranks(path: str) -> bytes:
    """Content of a rank file. It is read once, where the job starts, and travels with the tasks: a vocabulary is small."""
    with open(path, "rb") as file:
        return file.read()


def encode_texts(
    df: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False
) -> DataFrame:
    """Token ids of every whole text: ``doc_id, n_tokens, ids`` (little-endian unsigned 32-bit integers).

    Each match of ``pattern`` is encoded by itself; there are no special tokens. A null text counts as empty and gives no
    ids. Rows are independent: repeated rows and null doc_ids are kept as they are, an empty table gives an empty table.
    Only the two named columns are read. With ``decoded`` the ids are decoded again in the same pass, as
    :func:`decode_ids` does.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode = coder(ranks, pattern).encode
        ids = [encode(text or "") for text in batch.column("text").to_pylist()]
        columns = {"doc_id": batch.column("doc_id"), "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64())}
        columns["ids"] = pa.array(ids, pa.binary())
        if decoded:
            columns["decoded"] = pa.array([decode(x, vocabulary(ranks)) for x in ids], pa.binary())
        return pa.RecordBatch.from_pydict(columns)

    rows = pick(df, doc_id=id_col, text=text_col)
    rows = rows.withColumn("doc_id", rows["doc_id"].cast("bigint"))
    return map_slices(rows, run, DECODED_SCHEMA if decoded else ENCODED_SCHEMA, "text")


def decode(ids: bytes | None, tokens: list[bytes]) -> bytes:
    """Bytes of packed ids; null counts as none."""
    return b"".join(map(tokens.__getitem__, np.frombuffer(ids or b"", dtype="<u4").tolist()))


def decode_ids(df: DataFrame, ranks: bytes) -> DataFrame:
    """The rows of :func:`encode_texts` with the bytes of their ids in a further column ``decoded``."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = {c: batch.column(c) for c in ("doc_id", "n_tokens", "ids")}
        parts = [decode(x, vocabulary(ranks)) for x in columns["ids"].to_pylist()]
        return pa.RecordBatch.from_pydict(columns | {"decoded": pa.array(parts, pa.binary())})

    return map_slices(df.select("doc_id", "n_tokens", "ids"), run, DECODED_SCHEMA, "ids")
