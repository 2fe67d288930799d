"""Token ids of whole texts, by the tokenizers library.

The vocabulary's tokenizer drops white space, so a text's ids are its words' ids one after another. Arrow splits texts into words
and numbers them; distinct words of common letters are split into the pieces of the vocabulary's pattern, also by Arrow, and each
distinct piece goes once through the library's own model and is remembered. Any other word is encoded whole by the library, so
ids are always the library's. Numpy puts the ids together. All this holds for vocabularies with the normaliser and the split of FORM;
texts of any other vocabulary file are encoded whole by the library. Ids must fit 16 bits.
"""

from __future__ import annotations

import json
import os
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

END_ID = 1
#: Texts are taken in slices of about so many bytes, so that memory doesn't follow the batch.
SLICE_BYTES = 8 << 20
#: Remembered pieces before all are forgotten; about 50 bytes each.
CACHE_PIECES = 1_000_000
#: Words of these characters are the same under NFC, and lower-case letter by letter.
PLAIN = r"^[\x21-\x3b\x3d-\x7e\x{C0}-\x{12F}\x{131}-\x{24F}]*$"
#: The vocabulary's own pattern.
PIECE = r"('s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+)"

#: Lower-case words without digits and apostrophes: their pieces are the runs of letters and those of other characters.
SIMPLE = r"^[\x21-\x26\x28-\x2f\x3a\x3b\x3d-\x40\x5b-\x7e\x{DF}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}]*$"
SIGNS = r"([\x21-\x26\x28-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]+)"


# The normaliser, split and word end of vocabulary files whose texts are taken apart here.
FORM = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "split": {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
    "model": {"type": "BPE", "dropout": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>"},
}


def known_form(path: str) -> bool:
    """Whether a vocabulary file drops white space, lower-cases and splits as FORM says."""
    x = json.loads(Path(path).read_text())
    steps = (x.get("pre_tokenizer") or {}).get("pretokenizers") or []
    model = {k: (x.get("model") or {}).get(k) for k in FORM["model"]}
    bytes_ = len(steps) == 2 and steps[1].get("type") == "ByteLevel" and not steps[1].get("add_prefix_space") and not steps[1].get("use_regex")
    return x.get("normalizer") == FORM["normalizer"] and bytes_ and steps[0] == FORM["split"] and model == FORM["model"]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class Encoder:
    """Ids of many texts at once. One lives in each Python worker, with the pieces it has met."""

    _own: dict[str, "Encoder"] = {}

    @classmethod
    def get(cls, path: str) -> "Encoder":
        if path not in cls._own:
            cls._own[path] = cls(path)
        return cls._own[path]

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError(f"{path} has ids beyond 65,535")
        self.known_form = known_form(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([""], pa.large_string())
        self.ids = np.zeros(1 << 16, np.uint16)
        self.at = np.zeros(1 << 16, np.int64)
        self.size = np.zeros(1 << 16, np.int32)
        self.used = 0

    def _piece(self, piece: str) -> list[int]:
        text = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        return [t.id for t in self.model.tokenize(text)]

    def _whole(self, word: str) -> list[int]:
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def _numbers(self, parts: pa.Array) -> np.ndarray:
        """The number of each distinct piece in the memory. A word that is no piece is one with a line feed before it."""
        if len(self.known) + len(parts) > CACHE_PIECES:
            self._forget()
        found = pc.index_in(parts, value_set=self.known)
        new = parts.filter(pc.is_null(found))
        out = np.array(pc.fill_null(found, -1))
        if len(new):
            ids = [self._whole(x[1:]) if x[0] == "\n" else self._piece(x) for x in new.to_pylist()]
            sizes = np.fromiter(map(len, ids), np.int32, len(ids))
            flat = np.fromiter((x for part in ids for x in part), np.uint16, int(sizes.sum()))
            start, n = len(self.known), len(self.known) + len(new)
            self.known = pa.concat_arrays([self.known, new])
            self.ids, self.at, self.size = (_room(a, m) for a, m in ((self.ids, self.used + len(flat)), (self.at, n), (self.size, n)))
            self.ids[self.used : self.used + len(flat)] = flat
            self.size[start:n] = sizes
            self.at[start:n] = self.used + np.cumsum(sizes) - sizes
            self.used += len(flat)
            out[out < 0] = np.arange(start, n)
        return out

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, starts) of distinct words, with the end."""
        plain = pc.match_substring_regex(words, PLAIN)
        low = pc.utf8_lower(words)
        simple = pc.match_substring_regex(low, SIMPLE)
        spaced = pc.replace_with_mask(pc.replace_substring_regex(low, SIGNS, r" \1 "), pc.invert(simple), pc.replace_substring_regex(low.filter(pc.invert(simple)), PIECE, r"\1 "))
        # The others are kept whole; a line feed is in no word.
        spaced = pc.if_else(plain, spaced, pc.binary_join_element_wise(pa.scalar("", pa.large_string()), words, pa.scalar("\n", pa.large_string())))
        parts = pc.split_pattern(spaced, " ")
        bounds = np.asarray(parts.offsets) - parts.offsets[0].as_py()
        coded = parts.flatten().dictionary_encode()
        numbers = self._numbers(coded.dictionary)[np.asarray(coded.indices)]
        sizes = self.size[numbers]
        upto = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
        return self.ids[_runs(self.at[numbers], sizes, upto)], upto[bounds]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, starts): all ids of the texts, each text's with the end id behind, and where each text starts, with the end."""
        if not self.known_form:
            parts = [np.array([*x.ids, END_ID], np.uint16) for x in self.tokenizer.encode_batch([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
            return np.concatenate(parts) if parts else np.zeros(0, np.uint16), np.concatenate(([0], np.cumsum([len(x) for x in parts], dtype=np.int64)))
        words = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
        bounds = np.asarray(words.offsets) - words.offsets[0].as_py()
        coded = words.flatten().dictionary_encode()
        n_texts = len(texts)
        if len(coded):
            word_ids, word_at = self._words(coded.dictionary)
            codes = np.asarray(coded.indices)
            sizes, at = np.diff(word_at)[codes], word_at[codes]
        else:
            word_ids, sizes, at = np.zeros(0, np.uint16), np.zeros(0, np.int64), np.zeros(0, np.int64)
        upto = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
        starts = upto[bounds] + np.arange(n_texts + 1)
        ids = np.full(int(starts[-1]), END_ID, np.uint16)
        is_id = np.ones(len(ids), bool)
        is_id[starts[1:] - 1] = False
        ids[is_id] = word_ids[_runs(at, sizes, upto)]
        return ids, starts


def _runs(at: np.ndarray, sizes: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """The places at, at + 1, ... of each run, all in a row."""
    return np.arange(int(upto[-1])) + np.repeat(at - upto[:-1], sizes)


def _room(a: np.ndarray, n: int) -> np.ndarray:
    if n <= len(a):
        return a
    out = np.zeros(max(n, 2 * len(a)), a.dtype)
    out[: len(a)] = a
    return out


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES):
    """The batch in slices with about `most` bytes of text at most, but one row at least."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).cast(pa.int64()))
    upto, start = np.cumsum(sizes), 0
    while start < len(sizes):
        end = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + most, "right")))
        yield batch.slice(start, end - start)
        start = end
