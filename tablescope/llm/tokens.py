"""Ids of a public subword vocabulary, word by word.

The vocabulary drops white space and splits words from each other before it merges, so the ids of a text are the ids
of its blank-separated words one after another. Words repeat; their ids are kept, and only new words are encoded.
"""

from __future__ import annotations

import os
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

VOCABULARY = "word_bpe_49k.json"
#: Ids of ``VOCABULARY`` run from 0 to 49,407.
N_IDS = 49_408
#: Ids of the special strings; a text that holds one of them is encoded whole, as the library does by default.
START_ID, END_ID = 49_406, 49_407


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


#: A word of Latin letters that ends in ASCII signs, if at all: its letters are one word, its end another.
SIMPLE = r"^(?P<core>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<end>[!-/:-@\[-`{-~]*)$"
#: distinct ends that are remembered
MOST_ENDS = 10_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable bytes for themselves, the others from code point 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


def cells(column: pa.Array) -> list:
    """The cells of a column without NULL, as ``to_pylist`` gives them but not one Arrow scalar after another."""
    return column.to_numpy(zero_copy_only=False).tolist()


class Words:
    """The blank-separated words of some texts: distinct words, and for each text its words' places among them."""

    def __init__(self, texts: pa.Array):
        lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        offsets = lists.offsets.to_numpy()
        found = lists.flatten().dictionary_encode()
        self.names = found.dictionary
        index = found.indices.to_numpy()
        bounds = (offsets - offsets[0]).astype(np.int64)
        blank = pc.index(self.names, pa.scalar("", self.names.type)).as_py()
        if blank >= 0:  # blanks at either end of a text
            keep = index != blank
            bounds = np.concatenate([[0], np.cumsum(keep)])[bounds]
            index = index[keep]
        self.index, self.bounds = index, bounds

    @cached_property
    def distinct(self) -> list[str]:
        return cells(self.names)


class WordIds:
    """Ids as little-endian unsigned 32-bit numbers.

    Words are remembered in two generations of about ``keep`` each; a word that is used again moves to the younger
    one, and the older one is forgotten as a whole. ``path`` names the vocabulary file.
    """

    def __init__(self, path: str | None = None, keep: int = 150_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or vocabulary_path())
        self.merge = self.tokenizer.model.tokenize
        self.letters = byte_letters()
        self.keep = keep
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.ends: dict[str, bytes] = {"": b""}
        self.ready: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        found = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0]
        return np.array(found.ids, dtype="<u4").tobytes()

    def of_simple(self, words: list[str]) -> dict[str, bytes]:
        """Ids of those of the words that are letters and an end; each run of letters is merged once."""
        found = pc.extract_regex(pa.array(words, pa.string()), SIMPLE)
        cores = pc.utf8_lower(pc.struct_field(found, "core")).dictionary_encode()
        ends = pc.struct_field(found, "end").dictionary_encode()
        letters = "\n".join(cells(cores.dictionary))
        if not letters:
            return {}
        if not letters.isascii():
            for c in set(letters):
                if not c.isascii():
                    letters = letters.replace(c, "".join([self.letters[b] for b in c.encode()]))
        merge, ids, sizes = self.merge, [], [0]
        for core in letters.split("\n"):
            tokens = merge(core)
            sizes.append(len(tokens))
            ids += [t.id for t in tokens]
        data = np.array(ids, "<u4").tobytes()
        upto = (np.cumsum(sizes) * 4).tolist()
        first = [data[a:b] for a, b in zip(upto, upto[1:])]
        last = [self.end(e) for e in cells(ends.dictionary)]
        at = zip(words, cells(cores.indices.fill_null(-1)), cells(ends.indices.fill_null(-1)))
        return {w: first[i] + last[e] for w, i, e in at if i >= 0}

    def end(self, signs: str) -> bytes:
        if signs not in self.ends:
            if len(self.ends) > MOST_ENDS:
                self.ends = {"": b""}
            self.ends[signs] = self.encode(signs)
        return self.ends[signs]

    def new_word(self, word: str) -> bytes:
        found = self.ready.get(word)
        return self.encode(word) if found is None else found

    def of_words(self, words: list[str]) -> list[bytes]:
        if len(self.young) > self.keep:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        found = list(map(young.get, words))
        at = [i for i, ids in enumerate(found) if ids is None]
        missing = [words[i] for i in at]
        kept = list(map(old.get, missing))
        self.ready = self.of_simple([w for w, ids in zip(missing, kept) if ids is None]) if missing else {}
        for i, w, ids in zip(at, missing, kept):
            found[i] = young[w] = self.new_word(w) if ids is None else ids
        self.ready = {}
        return found

    def of_distinct(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the distinct words one after another, and where each word begins; one bound more at the end."""
        found = self.of_words(words.distinct)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        return np.frombuffer(b"".join(found), dtype="<u4"), np.concatenate([[0], np.cumsum(sizes)])

    def of_texts(self, texts: pa.Array, words: Words | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and where each text begins; one bound more at the end."""
        words = words or Words(texts)
        data, begin = self.of_distinct(words)
        index = words.index
        sizes = np.diff(begin)[index]
        after = np.cumsum(sizes)
        total = int(after[-1]) if len(after) else 0
        ids = data[np.repeat(begin[:-1][index] - (after - sizes), sizes) + np.arange(total)]
        bounds = np.concatenate([[0], after])[words.bounds]
        special = pc.match_substring_regex(texts, r"<\|(startoftext|endoftext)\|>")
        if pc.any(special).as_py():
            parts = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
            for i in np.flatnonzero(special.to_numpy(zero_copy_only=False)):
                parts[i] = np.frombuffer(self.encode(texts[i].as_py()), dtype="<u4")
            ids = np.concatenate(parts)
            bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids, bounds


_KEPT: dict[str, WordIds] = {}


def word_ids(path: str | None = None) -> WordIds:
    """One instance in each Python worker."""
    path = path or vocabulary_path()
    if path not in _KEPT:
        _KEPT[path] = WordIds(path)
    return _KEPT[path]
