"""BPE encoding and decoding by traversal of a prefix-sharing trie of words."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, documents, ragged

TOKENIZER = "byte_bpe_50k.json"
#: Words whose encodings a worker remembers at most.
CACHED_WORDS = 200_000
#: Bytes of text, and a quarter as many ids, that are worked on at once.
PORTION = 1 << 19
#: Pairs of tokens whose fit a worker remembers at most.
CACHED_PAIRS = 100_000
#: How byte-level BPE cuts a text into words (fixed values: the published pattern of such vocabularies).
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def _byte_letters() -> dict[str, int]:
    """The letter by which byte-level vocabularies write each byte: itself if printable, else one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def _refuse_others(spec: dict, path: str) -> None:
    """Files that ask for more than byte-level words and merges would be encoded wrongly: they are refused."""
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    flags = ("lstrip", "rstrip", "single_word")
    plain = {
        "a normalizer": spec.get("normalizer"),
        "another pre-tokenizer": pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True),
        "another model": model.get("type") != "BPE",
        "a part of the BPE model": any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")),
        "an added token's flags": any(t.get(k) for t in spec["added_tokens"] for k in flags),
    }
    for what, there in plain.items():
        if there:
            raise ValueError(f"{path} has {what}, which is not supported")


class Vocabulary:
    """Tokens and merges of a byte-level BPE, read from a tokenizers JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        _refuse_others(spec, path)
        letters = _byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.bytes: dict[int, bytes] = {i: s.encode() for s, i in self.special.items()}
        self.ids: dict[bytes, int] = {}
        for token, i in spec["model"]["vocab"].items():
            if token not in self.special:
                self.bytes[i] = b = bytes(letters[c] for c in token)
                self.ids[b] = i
        #: rank of a pair; for a merged token its two parts and its rank (single bytes: rank -1)
        self.pair: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {i: -1 for i in self.ids.values()}
        for r, merge in enumerate(spec["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            a, b = (self.ids[bytes(letters[c] for c in side)] for side in (left, right))
            merged = self.ids[self.bytes[a] + self.bytes[b]]
            self.pair[a, b] = r
            self.parts[merged], self.rank[merged] = (a, b), r
        self.longest = max(map(len, self.ids))
        self._fits: dict[tuple[int, int], bool] = {}
        self._whole: dict[int, bool] = {}
        self._cache: dict[str, bytes] = {}
        self._four = {i: np.int32(i).tobytes() for i in self.bytes}
        n = max(self.bytes) + 1
        self.pieces = Pieces([self.bytes.get(i, b"") for i in range(n)])
        self.decimals = Pieces([b"%d," % i for i in range(n)])

    def fits(self, a: int, b: int) -> bool:
        """Whether BPE leaves token b after token a as they are.

        Told backwards in time: at first both stand side by side; undoing the younger of the two tokens at the
        border gives the border before. At no border may its pair have been merged before the merge that
        really consumed one of its sides. Of equal pairs the leftmost is merged first.
        """
        known = self._fits.get((a, b))
        if known is not None:
            return known
        x, y, x_used, y_used = a, b, len(self.pair), len(self.pair)
        ok = True
        while True:
            r = self.pair.get((x, y))
            if r is not None and r < x_used and r <= y_used:
                ok = False
                break
            if self.rank[x] < 0 and self.rank[y] < 0:
                break
            if self.rank[x] > self.rank[y]:
                x_used, x = self.rank[x], self.parts[x][1]
            else:
                y_used, y = self.rank[y], self.parts[y][0]
        if len(self._fits) > CACHED_PAIRS:
            self._fits.clear()
        self._fits[a, b] = ok
        return ok

    def whole(self, t: int) -> bool:
        """Whether the token's own bytes are encoded as that one token."""
        if t not in self._whole:
            self._whole[t] = self.rank[t] < 0 or (self.whole(self.parts[t][0]) and self.whole(self.parts[t][1]) and self._joins(t))
        return self._whole[t]

    def _joins(self, t: int) -> bool:
        """Whether nothing across the border of the token's two parts is merged before their own merge."""
        a, b = self.parts[t]
        x, y, x_used, y_used = a, b, self.rank[t], self.rank[t]
        while self.rank[x] >= 0 or self.rank[y] >= 0:
            if self.rank[x] > self.rank[y]:
                x_used, x = self.rank[x], self.parts[x][1]
            else:
                y_used, y = self.rank[y], self.parts[y][0]
            r = self.pair.get((x, y))
            if r is not None and r < x_used and r <= y_used:
                return False
        return True

    def encode_words(self, words: set[str]) -> None:
        """Put the encodings of distinct words into the cache.

        Sorted words are the depth-first order of their trie. Each node holds one state, the last token of its
        prefix's encoding: the one token that ends there and fits the state of the node where it begins. States
        of the path are kept on a stack, so a prefix that many words share is encoded once. A word's encoding is
        read backwards from its last state, so a word of any length takes memory in proportion to it.
        """
        ids, fits, known, cache, four = self.ids.get, self.fits, self._fits.get, self._cache, self._four
        path, last, begin = b"", [-1], [0]
        longest = self.longest
        for text in sorted(words, key=str.encode):
            word = text.encode()
            n = min(len(word), len(path))
            share = 0
            while share < n and word[share] == path[share]:
                share += 1
            del last[share + 1 :], begin[share + 1 :]
            for i in range(share + 1, len(word) + 1):
                # only one start fits, so they are tried in the order of how likely they are: where the token
                # before this byte began, after that, before that
                b = begin[-1]
                for j in chain((b,), range(b + 1, i), range(i - longest if i > longest else 0, b)):
                    t = ids(word[j:i])
                    if t is None:
                        continue
                    if j:
                        before = last[j]
                        ok = known((before, t))
                        if ok is None:
                            ok = fits(before, t)
                    else:
                        ok = self.whole(t)
                    if ok:
                        last.append(t)
                        begin.append(j)
                        break
            path = word
            i = len(word)
            if begin[i]:
                tokens = []
                while i:
                    tokens.append(four[last[i]])
                    i = begin[i]
                cache[text] = b"".join(reversed(tokens))
            else:
                cache[text] = four[last[i]]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Token ids of each text, as int32 bytes."""
        cut = [self._segments(t) for t in texts]
        cache = self._cache
        new = {w for parts in cut for p in parts if isinstance(p, list) for w in p if w not in cache}
        if len(cache) + len(new) > CACHED_WORDS:
            used = {w for parts in cut for p in parts if isinstance(p, list) for w in p}
            self._cache = cache = {w: cache[w] for w in used if w in cache}
        self.encode_words(new)
        get = cache.__getitem__
        return [b"".join(b"".join(map(get, p)) if isinstance(p, list) else p for p in parts) for parts in cut]

    def _segments(self, text: str) -> list:
        """A text as lists of words, with the ids of special tokens between them."""
        if self.special_pattern is None or not any(s in text for s in self.special):
            return [WORDS.findall(text)]
        parts = self.special_pattern.split(text)
        return [np.int32(self.special[p]).tobytes() if k % 2 else WORDS.findall(p) for k, p in enumerate(parts)]


class Pieces:
    """Byte strings by number, to be strung together by arrays of numbers."""

    def __init__(self, items: list[bytes]):
        self.data = np.frombuffer(b"".join(items), np.uint8)
        self.length = np.array([len(x) for x in items], np.int64)
        self.start = np.cumsum(self.length) - self.length

    def join(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of ids[bounds[k]:bounds[k + 1]] strung together for each k, and the offsets of the results."""
        length = self.length[ids]
        ends = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(length, out=ends[1:])
        return self.data[ragged(self.start[ids], length)], ends[bounds]


_VOCABULARIES: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The worker's vocabulary of that file, read once."""
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary(path)
    return _VOCABULARIES[path]


def _portions(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    ends, i = np.cumsum(sizes), 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + limit, "right")))
        yield i, j
        i = j


def _strings(ids: np.ndarray, bounds: np.ndarray, pieces: Pieces, drop: int = 0) -> pa.Array:
    """ids[bounds[k]:bounds[k + 1]] written with ``pieces``, ``drop`` bytes less at the end of each that has any;
    bytes that are not UTF-8 become U+FFFD."""
    data, ends = pieces.join(ids, bounds)
    data = data.tobytes()
    return pa.array([data[i : max(i, j - drop)].decode("utf-8", "replace") for i, j in zip(ends[:-1], ends[1:])], pa.string())


#: Columns that coding adds, and how each is made of a vocabulary, ids and their bounds.
_CODED = {
    "ids": ("array<int>", lambda v, ids, bounds: pa.ListArray.from_arrays(bounds.astype(np.int32), ids)),
    "decoded": ("string", lambda v, ids, bounds: _strings(ids, bounds, v.pieces)),
    "ids_text": ("string", lambda v, ids, bounds: _strings(ids, bounds, v.decimals, 1)),
}


def _adding(df: DataFrame, source: str, columns: tuple[str, ...], path: str, ids_of) -> DataFrame:
    """``df`` with coded columns added; texts are worked on in portions of about PORTION bytes."""
    keep = [f for f in df.schema.fields if f.name not in columns]
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), *(f"{c} {_CODED[c][0]}" for c in columns)])
    names = [f.name for f in keep]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in it:
            for i, j, ids, bounds in ids_of(vocab, batch.column(source)):
                made = [_CODED[c][1](vocab, ids, bounds) for c in columns]
                yield pa.RecordBatch.from_arrays([*(batch.column(n)[i:j] for n in names), *made], names=[*names, *columns])

    return bounded_batches(df).mapInArrow(run, ddl)


def encode(docs: DataFrame, text_col: str = "text", path: str | None = None, also: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with ``ids`` added: the token ids of the whole text, as the tokenizers library encodes it without
    special tokens added, truncation or padding. Special tokens written in a text become their ids.

    ``also`` may name ``decoded`` (the text that the ids decode to) and ``ids_text`` (the ids in decimal, joined
    by commas), made from the ids in the same pass.

    Defined cases: null counts as the empty text, which has no ids; ties and repeated rows are each encoded; an
    empty table gives no rows; columns with the new names are replaced. Memory is bounded by a batch of texts
    and CACHED_WORDS words.
    """

    def ids_of(vocab: Vocabulary, text: pa.Array):
        sizes = pa.compute.binary_length(text).fill_null(0).to_numpy(zero_copy_only=False)
        for i, j in _portions(sizes, PORTION):
            parts = vocab.encode([t or "" for t in text[i:j].to_pylist()])
            bounds = np.zeros(len(parts) + 1, np.int64)
            np.cumsum([len(p) // 4 for p in parts], out=bounds[1:])
            yield i, j, np.frombuffer(b"".join(parts), np.int32), bounds

    return _adding(docs, text_col, ("ids", *also), path or default_path(), ids_of)


def decode(docs: DataFrame, ids_col: str = "ids", path: str | None = None, columns: tuple[str, ...] = ("decoded",)) -> DataFrame:
    """``docs`` with ``decoded`` added: the text of the ids, special tokens included; bytes that are not UTF-8
    become U+FFFD. Null ids are the empty text. ``columns`` may also name ``ids_text``."""

    def ids_of(vocab: Vocabulary, ids: pa.Array):
        flat = ids.flatten().to_numpy(zero_copy_only=False)
        sizes = ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        for i, j in _portions(sizes, PORTION // 4):
            yield i, j, flat[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]

    return _adding(docs, ids_col, columns, path or default_path(), ids_of)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of encoded and decoded documents."""
    coded = encode(docs.select("doc_id", "text"), also=("decoded", "ids_text"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2("ids_text", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))
