"""SentencePiece (BPE) encoding and decoding by a merge-type prefix table.

BPE's result on a text is the only split into tokens in which every two neighbours are compatible, that is, BPE of
their joined text gives just these two back. So the encoding of each prefix has one last token, found among the
tokens that end there (one pass of an automaton over the text): the one that is compatible with the last token of the
prefix before it. The table of last tokens is filled left to right, and the ids are read off it backwards.

No piece of a model this operator takes holds a space mark after another character, so words are encoded apart and
the ids of words already seen are reused from a cache of bounded size. Characters that are no piece become their
UTF-8 bytes' pieces. Whole texts are encoded, without begin or end ids and without sampling.

Null counts as empty text, which has no ids. Very long texts are encoded whole, word by word, one text at a time; an empty
table gives no rows. Repeated rows and extra columns are fine.
"""

from __future__ import annotations

import codecs
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from gatewright.llm.common import WordCache, table

MARK = "▁"
#: Words that a worker keeps: two generations of this many.
CACHED = 400_000
#: Characters that often follow a word.
TAILS = ".,;:!?*&#$%|"

class PieceEncoder:
    """Encoder and decoder of one model file (BPE, identity normalization, byte fallback, dummy prefix)."""

    def __init__(self, model_file: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = sp.get_piece_size()
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(size)]
        self.pieces = [sp.id_to_piece(i) for i in range(size)]
        self.score = {p: sp.get_score(i) for i, p in enumerate(self.pieces) if not special[i] and not sp.is_byte(i)}
        self.ids = {p: i for i, p in enumerate(self.pieces) if p in self.score}
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.special = {i for i in range(size) if special[i]}
        self.plain = set(self.ids.values())
        if len(self.bytes) != 256 or any(MARK in p.lstrip(MARK) for p in self.score):
            raise ValueError("the model needs byte pieces and no piece with a space mark inside")
        if "\n" in "".join(self.score):
            raise ValueError("the model has a piece with a line end")
        self.sizes = [len(p) for p in self.pieces]
        self.characters = {p for p in self.ids if len(p) == 1}
        self.spelt = [p.replace(MARK, " ") for p in self.pieces]
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            if self._merge(p) == [p]:  # a piece that merging never makes is never a token
                self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        self._compatible: dict[int, bool] = {}

    def _merge(self, text: str) -> list[str]:
        """Plain BPE of a short text of pieces' characters: best score first, leftmost of equal ones."""
        parts = list(text)
        score = self.score
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, left: int, right: int) -> bool:
        """Whether BPE keeps these two tokens side by side."""
        key = left * 1_000_003 + right
        known = self._compatible.get(key)
        if known is None:
            a, b = self.pieces[left], self.pieces[right]
            known = self._compatible[key] = self._merge(a + b) == [a, b]
        return known

    def _run(self, text: str) -> list[int]:
        """Ids of a text of which every character is a piece."""
        n = len(text)
        last = [-1] * (n + 1)
        compatible, checked, sizes = self._compatible, self.compatible, self.sizes
        for end, token in self.automaton.iter(text):
            end += 1
            if last[end] >= 0:
                continue
            start = end - sizes[token]
            if start:
                before = last[start]
                if before < 0:
                    continue
                ok = compatible.get(before * 1_000_003 + token)
                if not (checked(before, token) if ok is None else ok):
                    continue
            last[end] = token
        ids, at = [], n
        while at:
            token = last[at]
            ids.append(token)
            at -= sizes[token]
        ids.reverse()
        return ids

    def encode_word(self, word: str) -> list[int]:
        """Ids of a text of which space marks stand at the start alone."""
        if self.characters.issuperset(word):
            return self._run(word)
        out: list[int] = []
        known, run = self.characters, []
        for c in word:
            if c in known:
                run.append(c)
                continue
            if run:
                out += self._run("".join(run))
                run = []
            out.extend(self.bytes[b] for b in c.encode("utf-8", "replace"))
        if run:
            out += self._run("".join(run))
        return out

    def words(self, text: str) -> list[str]:
        """Parts of a text that are encoded apart: words, each with the space marks before it, and line ends, which
        are no pieces."""
        if not text:
            return []
        out: list[str] = []
        for k, line in enumerate((MARK + text.replace(" ", MARK)).split("\n")):
            if k:
                out.append("\n")
            first, *parts = line.split(MARK)
            if first:
                out.append(first)
            if "" not in parts:
                out += [MARK + p for p in parts]
                continue
            marks = 0
            for p in parts:
                marks += 1
                if p:
                    out.append(MARK * marks + p)
                    marks = 0
            if marks:
                out.append(MARK * marks)
        return out

    def encode(self, text: str) -> list[int]:
        return [i for w in self.words(text) for i in self.encode_word(w)]

    def decode(self, ids: list[int]) -> str:
        """Text of ids: marks become spaces, the first of them goes, byte pieces are read as UTF-8, what is no UTF-8
        becomes U+FFFD byte by byte."""
        if self.plain.issuperset(ids):
            text = "".join(map(self.spelt.__getitem__, ids))
            return text[1:] if text[:1] == " " else text
        out: list[str] = []
        run = bytearray()
        for k, i in enumerate(ids):
            b = self.byte_of.get(i)
            if b is not None:
                run.append(b)
                continue
            if run:
                out.append(_utf8(run))
                run = bytearray()
            if i not in self.special:
                p = self.spelt[i]
                out.append(p[1:] if not out and not k and p[:1] == " " else p)
        if run:
            out.append(_utf8(run))
        return "".join(out)


def _utf8(run: bytearray) -> str:
    return run.decode("utf-8", "gatewright_each_byte")


codecs.register_error("gatewright_each_byte", lambda e: ("\ufffd" * (e.end - e.start), e.end))


@lru_cache(maxsize=2)
def encoder(model_file: str) -> PieceEncoder:
    return PieceEncoder(model_file)


@lru_cache(maxsize=2)
def cached(model_file: str, with_ids: bool) -> tuple[PieceEncoder, WordCache]:
    """A worker process's encoder and cache, shared by its tasks. word -> (count, spelt ids, decoded text, first id,
    last id, ids).

    Two texts' encodings side by side are the encoding of both if the tokens at the seam are compatible (or one of
    them is a byte), so a word with punctuation after it is put together from two cached words where that holds.
    """
    enc = encoder(model_file)
    number = [str(i) for i in range(len(enc.pieces))]

    def entry(ids: list[int], space: str) -> tuple:
        return len(ids), ",".join([number[i] for i in ids]).encode(), space + enc.decode(ids), ids[0], ids[-1], ids if with_ids else None

    def make(word: str) -> tuple:
        stem = word.rstrip(TAILS)
        if stem and stem is not word and len(stem) < len(word):
            a, b = cache.one(stem), cache.one(word[len(stem) :])
            if a[4] in enc.byte_of or b[3] in enc.byte_of or enc.compatible(a[4], b[3]):
                return a[0] + b[0], a[1] + b"," + b[1], a[2] + b[2], a[3], b[4], a[5] + b[5] if with_ids else None
        # a word's own first space is not the text's
        return entry(enc.encode_word(word), " " * (word[0] == MARK))

    cache = WordCache(make, CACHED)
    return enc, cache


def encode_columns(df: DataFrame, key: str, text: str, model_file: str, digests: bool = False) -> DataFrame:
    """key with ids and decoded text of each row, or with their digests alone."""
    fields = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    slim = df.select(key, text)
    schema = f"`{key}` {dict(slim.dtypes)[key]}, {fields}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, cache = cached(model_file, not digests)
        for batch in batches:
            keys, rows = batch.column(0), []
            for value in batch.column(1):
                found = cache.all(enc.words(value.as_py() or ""))
                spelt = "".join([f[2] for f in found])[1:]
                if digests:
                    rows.append((sum(f[0] for f in found), hashlib.sha256(b",".join([f[1] for f in found])).hexdigest(), hashlib.sha256(spelt.encode()).hexdigest()))
                else:
                    rows.append(([i for f in found for i in f[5]], spelt))
            kinds = [pa.int64(), pa.string(), pa.string()] if digests else [pa.list_(pa.int32()), pa.string()]
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            names = ["n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays([keys, *columns], [key, *names])

    return slim.mapInArrow(run, schema)


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_columns(table(spark, sf_dir, "documents"), "doc_id", "text", public_tokenizers.path("piece_bpe_32k.model"), digests=True)


QUERIES = {"op8_pieces": op8_pieces}
