"""Pre-tokens of a word-level BPE vocabulary and their pieces, shared by token files and token counts.

A chunk of texts becomes codes into a dictionary of its distinct pre-tokens, in
Arrow's native code. The tokenizers library then encodes each distinct
pre-token that a worker does not know yet, once. Texts with characters whose
handling could depend on the Unicode version, or with a special token's
string, are cut by the library's own normaliser and pre-tokenizer instead; their
pre-tokens join the same dictionary.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from veldra.llm.bpe import byte_alphabet
from veldra.llm.common import Known

#: Distinct pre-tokens that a worker keeps the pieces of; beyond it the half that is used least goes.
CACHE_ENTRIES = 600_000

#: Bytes of text that share a dictionary of pre-tokens.
CHUNK_BYTES = 8 << 20

#: Characters outside those for which lower case, composition and classes are the same everywhere.
UNSTABLE = r"[^\t\n\r\x20-\x7e\x{a1}-\x{12f}\x{131}-\x{24f}\x{2010}-\x{2027}\x{20ac}]"

#: The pre-tokenisation pattern that the vocabulary is published with (fixed value).
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: What of a text without white space is not a run of letters: by the pattern above, a pre-token of its own.
APART = r"'s|'t|'re|'ve|'m|'ll|'d|\p{N}|[^\s\p{L}\p{N}]+"


def _check(spec: dict) -> None:
    """Refuse a file whose texts are handled otherwise than this module does."""
    kinds = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", ())]
    parts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", ())
    pattern = parts[0].get("pattern", {}).get("Regex") if parts else None
    model = spec["model"]
    right = kinds == ["NFC", "Replace", "Lowercase"] and pattern == PRETOKEN and parts[0].get("behavior") == "Removed" and parts[0].get("invert") and [p["type"] for p in parts[1:]] == ["ByteLevel"]
    if not right or model.get("type") != "BPE" or model.get("end_of_word_suffix") != "</w>" or model.get("dropout"):
        raise ValueError("the vocabulary's normaliser, pre-tokenizer or model is not of the kind that this operator reads")
    if any(t.get("normalized") or t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec["added_tokens"]):
        raise ValueError("an added token is matched otherwise than by its plain string")


class PreTokens:
    """Cuts texts, and encodes distinct pre-tokens by the library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        _check(spec)
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        strings = [regex.escape(s, special_only=True) for s in sorted(self.specials, key=len, reverse=True)]
        self.special = regex.compile("|".join(strings)) if strings else None
        self.unstable = "|".join([UNSTABLE, *strings])
        self.library = Tokenizer.from_file(path)
        self.back = {c: b for b, c in byte_alphabet().items()}
        # The same library and model for strings that are pre-tokens already, parted by spaces.
        bare = spec | {"normalizer": None, "post_processor": None, "added_tokens": [], "truncation": None, "padding": None}
        bare["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, *spec["pre_tokenizer"]["pretokenizers"][1:]]}
        self.model = Tokenizer.from_str(json.dumps(bare))
        vocabulary = self.library.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True  # a pre-token's last piece is marked

    def cut(self, text: str) -> list[str]:
        """The pre-tokens of any text by the library's own parts; a special token's string is one of them."""
        out: list[str] = []
        at = 0
        for found in [*(self.special.finditer(text) if self.special else ()), None]:
            part = text[at : found.start() if found else len(text)]
            if part:
                pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))
                out += [bytes(self.back[c] for c in piece).decode() for piece, _ in pieces]
            if found:
                out.append(found.group())
                at = found.end()
        return out

    def split(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Codes of all pre-tokens in order, each text's bounds in them, and the distinct pre-tokens."""
        unstable = pc.match_substring_regex(texts, self.unstable)
        stable = pc.utf8_lower(pc.if_else(unstable, pa.scalar("", texts.type), texts))
        spaced = pc.replace_substring_regex(stable, APART, r" \0 ")
        lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(spaced))
        flat, bounds = lists.flatten(), np.asarray(lists.offsets, dtype=np.int64)
        bounds = bounds - bounds[0]
        odd = np.flatnonzero(np.asarray(unstable, dtype=bool))
        if len(odd):
            pieces, sizes = [], np.diff(bounds)
            for row, before in zip(odd.tolist(), [0, *(odd[:-1] + 1).tolist()]):
                own = pa.array(self.cut(texts[row].as_py()), flat.type)
                pieces += [flat.slice(bounds[before], bounds[row] - bounds[before]), own]
                sizes[row] = len(own)
            flat = pa.concat_arrays([*pieces, flat.slice(bounds[odd[-1] + 1])])
            bounds = np.concatenate([[0], np.cumsum(sizes)])
        coded = flat.dictionary_encode()
        codes, words = np.asarray(coded.indices), coded.dictionary
        return codes, bounds, words

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many pieces each of the distinct pre-tokens has, and the ids of all; an empty string has none."""
        sizes, ids = [np.empty(0, np.int32)], [np.empty(0, np.int32)]
        for at in range(0, len(words), 5000):
            some = words[at : at + 5000]
            own = np.array(self.model.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype=np.int32)
            ends = np.flatnonzero(self.ends[own]) + 1
            if len(ends) == len(some) and not any(w in self.specials for w in some):
                own_sizes = np.diff(ends, prepend=0)
            else:
                lists = [[self.specials[w]] if w in self.specials else self.model.encode(w, add_special_tokens=False).ids for w in some]
                own_sizes, own = np.array([len(x) for x in lists]), np.array([i for x in lists for i in x], dtype=np.int32)
            sizes.append(own_sizes.astype(np.int32)), ids.append(own)
        return np.concatenate(sizes), np.concatenate(ids)


class WordPieces:
    def __init__(self, path: str):
        self.pre = PreTokens(path)
        self.pieces, self.counts = Known(self.pre.encode, True, CACHE_ENTRIES), Known(self.pre.encode, False, CACHE_ENTRIES)

    def encode_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids in order, and how many each text has."""
        codes, bounds, words = self.pre.split(texts)
        ids, ends = self.pieces.gather(self.pieces.places(words), codes)
        running = np.concatenate([[0], ends])
        return ids, running[bounds[1:]] - running[bounds[:-1]]

    def count_texts(self, texts: pa.Array) -> np.ndarray:
        """How many pieces each text has: its pre-tokens' frequencies, joined to their counts of pieces, summed."""
        codes, bounds, words = self.pre.split(texts)
        at = self.counts.places(words)
        counts = self.counts.sizes[at].astype(np.int64)
        rows = np.repeat(np.arange(len(texts)), np.diff(bounds))
        pairs, frequency = np.unique(rows * max(1, len(words)) + codes, return_counts=True)
        row, code = np.divmod(pairs, max(1, len(words)))
        return np.bincount(row, weights=frequency * counts[code], minlength=len(texts)).astype(np.int64)


@lru_cache(maxsize=2)
def word_pieces(path: str) -> WordPieces:
    """A worker's pieces for a vocabulary file; the file must lie on every machine at that path."""
    return WordPieces(path)
