"""Token ids of whole texts by a vocabulary file of the ``tokenizers`` library.

For vocabularies that drop white space: a text is cut at ASCII white space, across which neither the normalizer nor the
pieces of such a vocabulary reach, and the ids of a part are remembered.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs the tasks side by side already

from tokenizers import Tokenizer  # noqa: E402

from twinfold.llm.common import cached_by, claim_memory  # noqa: E402

PART_CACHE = 800_000
CACHED_PART_CHARS = 64
WORDS_PER_CALL = 500
_WORD = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
# letters, then ASCII marks but no apostrophe, are two pieces of the vocabulary
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def read_vocabulary(path: str) -> str:
    """Content of a vocabulary file, read once where the job starts; it travels with the tasks."""
    with open(path, encoding="utf-8") as file:
        return file.read()


class SpaceFreeTokenizer:
    """Ids as little-endian unsigned 32-bit integers; no special tokens are added.

    Literals of special tokens in a text get their ids, as the library gives them: they are matched in the text as it is,
    before it is lower-cased, and cut it like white space.
    """

    def __init__(self, content: str):
        self._tokenizer = Tokenizer.from_str(content)
        self._tokenizer.encode_special_tokens = True  # parts hold no literal as it stands in the text
        added = self._tokenizer.get_added_tokens_decoder()
        if any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in added.values()):
            raise ValueError("this vocabulary has added tokens that are not plain literals")
        self._special = {t.content: ("special", i) for i, t in added.items()}
        names = sorted(self._special, key=len, reverse=True)
        self._literal = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        self._ids_of_special = {key: np.array([key[1]], dtype="<u4").tobytes() for key in self._special.values()}
        if self._tokenizer.encode("a \n b", add_special_tokens=False).ids != self._pair_ids():
            raise ValueError("this vocabulary keeps white space")
        vocabulary = self._tokenizer.get_vocab()
        self._is_end = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self._is_end[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._known: dict = {"": b"", **self._ids_of_special}

    def _pair_ids(self) -> list[int]:
        return [i for part in "ab" for i in self._tokenizer.encode(part, add_special_tokens=False).ids]

    @staticmethod
    def spaced(text: str) -> str:
        """The text with spaces for ASCII white space. Latin-1 texts are lower-cased first, as the vocabulary does by
        itself: in them no letter's case depends on its neighbours and nothing can be composed."""
        try:
            text.encode("latin-1")
            text = text.lower()
        except UnicodeEncodeError:
            pass
        for gap in "\n\t\r\x0b\x0c":
            text = text.replace(gap, " ")
        return text

    def split(self, text: str) -> list:
        """Parts of a text in order; a special token's literal is the key of its id."""
        found: list = []
        for i, piece in enumerate(self._literal.split(text)):
            found += [self._special[piece]] if i % 2 else self.spaced(piece).split(" ")
        return found

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text. Different parts are looked up once per call; those not yet known are encoded together."""
        known = self._known
        if len(known) > PART_CACHE:
            known.clear()
            known.update({"": b"", **self._ids_of_special})
        literal = {i: self.split(t) for i, t in enumerate(texts) if any(name in t for name in self._special)}
        spaced = pa.array(["" if i in literal else self.spaced(t) for i, t in enumerate(texts)], pa.large_string())
        split = pc.split_pattern(spaced, " ")
        coded = split.flatten().dictionary_encode()
        different = _strings(coded.dictionary)
        ids_of = list(map(known.get, different))
        unknown = {p for p, ids in zip(different, ids_of) if ids is None}
        unknown.update(p for row in literal.values() for p in row if p not in known)
        fresh = self._encode_unknown(unknown)
        ids_of = [fresh[p] if ids is None else ids for p, ids in zip(different, ids_of)]
        flat, ends = _joined(ids_of, np.asarray(coded.indices))
        cuts = ends[np.asarray(split.offsets)].tolist()
        result = [flat[a:b] for a, b in zip(cuts, cuts[1:])]
        for i, row in literal.items():
            result[i] = b"".join([fresh[p] if p in fresh else known[p] for p in row])
        # long parts are not remembered beyond this call
        known.update((p, ids) for p, ids in fresh.items() if len(p) <= CACHED_PART_CHARS)
        return result

    def _encode_unknown(self, unknown: set[str]) -> dict[str, bytes]:
        """Ids of parts that are not known, and of the pieces of those that are a word and marks."""
        known = self._known
        words = {p for p in unknown if _WORD(p)}
        rest, marked = unknown.difference(words), []
        for part in rest:
            word = part.rstrip(_MARKS)
            if len(word) < len(part) and _WORD(word):
                marked.append((part, word, part[len(word) :]))
        rest.difference_update([part for part, _, _ in marked])
        words.update([word for _, word, _ in marked if word not in known])
        rest.update([marks for _, _, marks in marked if marks not in known])
        fresh = dict(self._encode_words(list(words)))
        fresh.update(self._encode_each(list(rest)))
        for part, word, marks in marked:
            fresh[part] = (fresh.get(word) or known[word]) + (fresh.get(marks) or known[marks])
        return fresh

    def _encode_each(self, parts: list[str]) -> Iterator[tuple[str, bytes]]:
        found = self._tokenizer.encode_batch_fast(parts, add_special_tokens=False)
        return zip(parts, (np.asarray(e.ids, dtype="<u4").tobytes() for e in found))

    def _encode_words(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """Words of letters, many per call: the last token of each is marked as a word's end."""
        for at in range(0, len(words), WORDS_PER_CALL):
            some = words[at : at + WORDS_PER_CALL]
            found = self._tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)
            ids = np.asarray(found[0].ids, dtype="<u4")
            ends = np.flatnonzero(self._is_end[ids]) + 1
            if len(ends) == len(some) and ends[-1] == len(ids):
                packed, cuts = ids.tobytes(), (4 * ends).tolist()
                yield from ((w, packed[a:b]) for w, a, b in zip(some, [0, *cuts], cuts))
            else:
                yield from self._encode_each(some)


def _strings(values: pa.Array) -> list[str]:
    """Strings without nulls as a list, converted in one call: ``to_pylist`` makes a scalar object of each."""
    return values.to_numpy(zero_copy_only=False).tolist()


def _joined(values: list[bytes], order: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The values in the given order as one string, and where each begins, with the end of the last."""
    sizes = np.fromiter(map(len, values), dtype=np.int64, count=len(values))
    # as lists of 4-byte ids: their bytes are gathered in one pass
    bounds = pa.array(np.r_[0, np.cumsum(sizes // 4)])
    ids = pa.array(np.frombuffer(b"".join(values), dtype="<u4"))
    gathered = pa.LargeListArray.from_arrays(bounds, ids).take(pa.array(order))
    return np.asarray(gathered.flatten()).tobytes(), np.r_[0, np.cumsum(sizes[order])]


@lru_cache(maxsize=2)
def _tokenizer(content: str) -> SpaceFreeTokenizer:
    return SpaceFreeTokenizer(content)


cached_by("tokens", _tokenizer.cache_clear)


def tokenizer(content: str) -> SpaceFreeTokenizer:
    """One tokenizer per worker process and vocabulary."""
    claim_memory("tokens")
    return _tokenizer(content)
