"""BPE encoding by speculation: propose by longest match, check pairs, merge what fails.

The vocabulary is a ``tokenizers`` JSON file of the kind with word ends: NFC, white
space runs to one space, lower case, a split pattern, byte-level symbols, and
``</w>`` on the last symbol of a word. Its path is a parameter; nothing is trained.

A sequence of tokens is what the merges give exactly if each adjacent pair is: a
merge across the border of two tokens can only be kept from happening by an earlier
merge on one of its sides. So each distinct word is cut greedily into the longest
tokens, all adjacent pairs of a batch are tested at once over the merge table, and
only words with a failing pair are merged step by step.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from struct import pack

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import strings

END = "</w>"
#: Fixed values of the vocabulary's kind: its split pattern.
#: The same for texts of Latin-1 characters, in which it is faster.
SPLIT_LATIN = r"'s|'t|'re|'ve|'m|'ll|'d|[A-Za-zªµºÀ-ÖØ-öø-ÿ]+|[0-9²³¹¼-¾]|[^\t-\r \x85\xa0A-Za-zªµºÀ-ÖØ-öø-ÿ0-9²³¹¼-¾]+"
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"
#: Characters that newer Unicode tables call letters or numbers, and the library's do not, in hexadecimal.
NEWER = (
    "558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 "
    "10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF3 "
    "16FF4-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 "
    "1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F "
    "2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F "
)
#: Capitals that Python's tables do not know, the first and the last of a range, and how far off the small letter is.
CAPITALS = (
    (0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, -42343), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1),
    (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, -42561), (0x10D50, 0x10D65, 32), (0x16EA0, 0x16EB8, 27),
)
NEVER = np.int64(1) << 40


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def newer() -> str:
    """``NEWER`` as the inside of a character class."""
    return "".join("-".join(f"\\U{int(x, 16):08X}" for x in r.split("-")) for r in NEWER.split())


class Bpe:
    """Vocabulary, merge table and a bounded cache of words that were encoded.

    ``cache`` words are kept at most; when it is full it starts anew, so memory does
    not grow with the corpus.
    """

    def __init__(self, path: str, cache: int = 400_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        if model["end_of_word_suffix"] != END or spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}") != SPLIT:
            raise ValueError(f"{path}: not a vocabulary with word ends")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*self.vocab.values(), *self.special.values()])
        self.token = [""] * size
        for t, i in [*self.vocab.items(), *self.special.items()]:
            self.token[i] = t
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        #: The rank and the result of each merge, by the pair of ids.
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        born = np.full(size, -1, dtype=np.int64)  # the rank that makes a token; -1: a symbol
        left, right = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
        for r, (a, b) in enumerate(pairs):
            x, y, z = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.rank.setdefault((x, y), (r, z))
            if born[z] < 0:
                born[z], left[z], right[z] = r, x, y
        self.born, self.left, self.right = born, left, right
        self.size = size
        keys = np.array([x * size + y for x, y in self.rank], dtype=np.int64)
        order = np.argsort(keys)
        found = np.array(list(self.rank.values()), dtype=np.int64)[order]
        self.pair_keys, self.pair_ranks, self.pair_made = keys[order], found[:, 0].copy(), found[:, 1].copy()
        self.symbol = byte_symbols()
        # Only tokens that their own merges give may be proposed. "\n" stands for the
        # word's end; on its own it is no token, and a word that is left with it fails.
        self.longest = ahocorasick.Automaton()
        for t, i in self.vocab.items():
            if self.merged(t) == [i]:
                self.longest.add_word(t.replace(END, "\n"), i)
        self.longest.add_word("\n", -1)
        self.longest.make_automaton()
        self.split = regex.compile(SPLIT)
        self.capitals = {c: c + by for first, last, by in CAPITALS for c in range(first, last + 1)}
        self.rare = regex.compile(f"[{newer()}{''.join(map(chr, self.capitals))}]")
        known = {k: rf"[\p{{{k}}}--[{newer()}]]" for k in "LN"}
        rare = SPLIT.replace(r"[\p{L}]", known["L"]).replace(r"[\p{N}]", known["N"])
        self.split_rare = regex.compile(rare.replace(r"[^\p{White_Space}\p{L}\p{N}]", rf"[^\p{{White_Space}}{known['L']}{known['N']}]"), regex.V1)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.split_latin = re.compile(SPLIT_LATIN)
        self.limit = cache
        self.ids: dict[str, bytes] = {}
        self.text: dict[str, bytes] = {}

    def merged(self, symbols: str) -> list[int]:
        """The exact way: apply the merge of least rank, leftmost first, until none is left."""
        parts = list(symbols.removesuffix(END))
        if symbols.endswith(END) and parts:
            parts[-1] += END
        ids = [self.vocab[p] for p in parts]
        before, after = list(range(-1, len(ids) - 1)), [*range(1, len(ids)), -1]
        ready = [(self.rank[p][0], i, p) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in self.rank]
        heapify(ready)
        while ready:
            _, i, pair = heappop(ready)
            j = after[i]
            if j < 0 or (ids[i], ids[j]) != pair:
                continue  # one of the two is gone
            ids[i], ids[j], after[i] = self.rank[pair][1], -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] >= 0 and (p := (ids[k], ids[after[k]])) in self.rank:
                    heappush(ready, (self.rank[p][0], k, p))
        return [i for i in ids if i >= 0]

    def merged_all(self, words: list[str]) -> list[list[int]]:
        """Like ``merged`` of each word, a merge in every word at a time; words of similar length together."""
        out: list[list[int]] = [[]] * len(words)
        sizes = np.array([len(w) for w in words])
        for low, high in ((0, 8), (8, 16), (16, 32), (32, 64)):
            rows = np.flatnonzero((sizes > low) & (sizes <= high))
            if not len(rows):
                continue
            ids = np.full((len(rows), high + 1), -1, dtype=np.int64)
            for r, k in enumerate(rows.tolist()):
                w = words[k]
                ids[r, : len(w)] = [*map(self.vocab.__getitem__, w[:-1]), self.vocab[w[-1] + END]]
            rank, made = self.lookup(ids[:, :-1], ids[:, 1:])
            go = np.arange(len(rows))
            columns = np.arange(high + 1)
            while len(go):
                at = rank[go].argmin(axis=1)
                alive = rank[go, at] < NEVER
                go, at = go[alive], at[alive]
                if not len(go):
                    break
                ids[go, at] = made[go, at]
                shift = columns + (columns > at[:, None])
                shift[:, -1] = np.minimum(shift[:, -1], high)
                moved = np.take_along_axis(ids[go], np.minimum(shift, high), axis=1)
                moved[:, -1] = -1
                ids[go] = moved
                shift = np.minimum(shift[:, :-1], high - 1)
                rank[go], made[go] = np.take_along_axis(rank[go], shift, axis=1), np.take_along_axis(made[go], shift, axis=1)
                rank[go, -1] = NEVER
                for k in (at - 1, at):
                    i, j = go[k >= 0], k[k >= 0]
                    j = np.minimum(j, high - 1)
                    rank[i, j], made[i, j] = self.lookup(ids[i, j], ids[i, j + 1])
            for k, row in zip(rows.tolist(), ids.tolist(), strict=True):
                out[k] = row[: row.index(-1)]
        for k in np.flatnonzero(sizes > 64).tolist():
            out[k] = self.merged(words[k] + END)
        return out

    def lookup(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rank of merging each pair of ids, NEVER if there is none, and what it makes; id -1 merges with nothing."""
        keys = a * self.size + b
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        hit = (self.pair_keys[at] == keys) & (a >= 0) & (b >= 0)
        return np.where(hit, self.pair_ranks[at], NEVER), np.where(hit, self.pair_made[at], -1)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the merges leave each pair of adjacent tokens side by side.

        Runs both merge trees backwards along the border. ``x`` and ``y`` are the
        pieces that touch the border, ``gone_x`` and ``gone_y`` the ranks at which
        they are merged away from it; the later of the two births is undone first.
        A merge of ``x`` with ``y`` that comes before both ends would have happened.
        Of equal ranks the left one comes first.
        """
        x, y = a.copy(), b.copy()
        gone_x, gone_y = np.full(len(a), NEVER), np.full(len(a), NEVER)
        fine, open_ = np.ones(len(a), dtype=bool), np.arange(len(a))
        while len(open_):
            r, _ = self.lookup(x[open_], y[open_])
            bad = (r < gone_x[open_]) & (r <= gone_y[open_]) & (r < NEVER)
            fine[open_[bad]] = False
            open_ = open_[~bad]
            bx, by = self.born[x[open_]], self.born[y[open_]]
            go = (bx >= 0) | (by >= 0)
            open_, bx, by = open_[go], bx[go], by[go]
            undo_x = bx > by
            i, j = open_[undo_x], open_[~undo_x]
            gone_x[i], x[i] = bx[undo_x], self.right[x[i]]
            gone_y[j], y[j] = by[~undo_x], self.left[y[j]]
        return fine

    def learn(self, words: list[str]) -> None:
        """Encode distinct words into the cache."""
        symbol = self.symbol
        spelled = [w if w.isascii() and w.isprintable() else "".join([symbol[c] for c in w.encode()]) for w in words]
        cut, sizes = [], []
        for w in spelled:
            proposed = [i for _, i in self.longest.iter_long(w + "\n")]
            cut += proposed
            sizes.append(len(proposed))
        flat = np.array(cut, dtype=np.int64)
        ends = np.cumsum(sizes)
        fails = np.zeros(len(flat), dtype=bool)
        fails[flat < 0] = True
        inner = np.setdiff1d(np.arange(len(flat) - 1), ends - 1, assume_unique=True)
        inner = inner[(flat[inner] >= 0) & (flat[inner + 1] >= 0)]
        fails[inner] |= ~self.compatible(flat[inner], flat[inner + 1])
        any_fail = np.logical_or.reduceat(fails, ends - np.array(sizes)) if len(flat) else fails
        exact = iter(self.merged_all([x for x, failed in zip(spelled, any_fail.tolist(), strict=True) if failed]))
        for w, end, n, failed in zip(words, ends.tolist(), sizes, any_fail.tolist(), strict=True):
            self.keep(w, next(exact) if failed else cut[end - n : end])

    def keep(self, word: str, ids: list[int]) -> None:
        self.ids[word] = pack(f"<{len(ids)}I", *ids)
        self.text[word] = " ".join(self.token[i] for i in ids).encode()

    def words(self, text: str) -> list[str]:
        """The pieces that are encoded one by one; special tokens are pieces of their own."""
        parts = self.specials.split(text) if self.specials and self.specials.search(text) else [text]
        out: list[str] = []
        for k, part in enumerate(parts):
            if k % 2:
                out.append(part)
            else:
                if part.isascii() or max(part) <= "\xff":
                    out += self.split_latin.findall(part.lower())
                else:
                    part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
                    rare = self.rare.search(part) is not None
                    out += (self.split_rare if rare else self.split).findall((part.translate(self.capitals) if rare else part).lower())
        return out

    def encode_all(self, texts: list[str]) -> Iterator[tuple[bytes, bytes]]:
        """For each text its ids, as little-endian unsigned 32-bit integers, and the decoded text.

        Decoding joins the tokens by spaces, special tokens included. Texts are
        taken in groups of a few million characters, so that the checks see many
        words at once and memory stays bounded.
        """
        at = 0
        while at < len(texts):
            to, chars = at, 0
            while to < len(texts) and (to == at or chars + len(texts[to]) < 2_000_000):
                chars += len(texts[to])
                to += 1
            split = [self.words(t) for t in texts[at:to]]
            new = set().union(*split) - self.ids.keys()
            if len(self.ids) + len(new) > self.limit:
                self.ids.clear()
                self.text.clear()
                new = set().union(*split)
            for s in new & self.special.keys():
                self.keep(s, [self.special[s]])
            self.learn(list(new - self.special.keys()))
            for words in split:
                yield b"".join(map(self.ids.__getitem__, words)), b" ".join(map(self.text.__getitem__, words))
            at = to


@lru_cache(maxsize=1)
def load(path: str) -> Bpe:
    return Bpe(path)


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, ids, decoded)`` of each row of ``docs``.

    ``ids`` is an array of token ids, without special tokens but those that the text
    spells; ``decoded`` is the decoded text. Null and empty texts have no ids and
    decode to the empty text. Repeated rows each get a row; other columns are ignored.
    ``path`` is read on the executors.
    """
    return _run(docs, path, doc_id, text, "doc_id long, ids array<long>, decoded string")


def digests(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Like ``encode``, but ``(doc_id, n_tokens, ids_sha256, decoded_sha256)``.

    The hashes are taken where the ids are made, so ids and texts need not travel.
    """
    return _run(docs, path, doc_id, text, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _run(docs: DataFrame, path: str, doc_id: str, text: str, schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for whole in it:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                found = bpe.encode_all([x or "" for x in strings(b.column(1))])
                if "ids" in names:
                    rows = [(np.frombuffer(i, dtype="<u4").astype(np.int64), d.decode()) for i, d in found]
                    columns = [pa.array([r[0] for r in rows], pa.list_(pa.int64())), pa.array([r[1] for r in rows], pa.string())]
                else:
                    sha = hashlib.sha256
                    rows = [(len(i) // 4, sha(i).hexdigest(), sha(d).hexdigest()) for i, d in found]
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), *columns], names)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(batches, schema)
