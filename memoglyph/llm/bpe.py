"""BPE encoding and decoding by dynamic programming over prefixes.

Each prefix of a word has one last token in its BPE encoding. A trie automaton over the vocabulary gives all tokens that
end at a position; the one whose predecessor (the last token of the shorter prefix) is compatible with it is stored, and
the back-pointers from the word's end give the ids. Two tokens are compatible if merging left to right never joins a
symbol of the one with a symbol of the other, which is read off their merge trees.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, types as T

from memoglyph.llm.common import arrow_columns, table

#: Bytes of remembered chunks (text between white space) and their ids in a task, in each of two generations, for a pass among
#: others and for one that has the executors to itself; a pair of tokens that is known counts for so many of them.
REMEMBERED_BYTES, REMEMBERED_ALONE, PAIR_BYTES = 24 << 20, 96 << 20, 160
_END = 0xF0000  # a symbol that ends a word is its byte from here
_NOT_SPACE_HERE = re.compile("[\x1c-\x1f]")  # str.split takes these as white space, the pattern does not
_NEVER = 1 << 60


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    stands = {b: chr(b) for b in plain}
    for i, b in enumerate(b for b in range(256) if b not in stands):
        stands[b] = chr(256 + i)
    return [stands[b] for b in range(256)]


class WordBpe:
    """Encoder of a tokenizer file with a word pattern, word-end marks and a merge list."""

    def __init__(self, spec: dict, remembered: int = REMEMBERED_BYTES):
        model = spec["model"]
        self.most_pairs = remembered // PAIR_BYTES
        self.mark = model.get("end_of_word_suffix") or ""
        vocab = model["vocab"]
        self.tokens = {i: t for t, i in vocab.items()} | {a["id"]: a["content"] for a in spec["added_tokens"]}
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.added_pattern = re.compile("(" + "|".join(re.escape(a) for a in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        #: a character that every added token has, if there is one: a text without it has none of them
        self.added_mark = next((c for c in min(self.added, key=len) if all(c in a for a in self.added)), "") if self.added else ""
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        kinds = {n["type"] for n in spec["normalizer"]["normalizers"]}
        self.nfc, self.lower = "NFC" in kinds, "Lowercase" in kinds
        symbols = byte_symbols()
        self.byte_of = {c: b for b, c in enumerate(symbols)}
        self.merged: dict[tuple[int, int], int] = {}  # pair -> rank
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        text: dict[int, str] = {}
        for b, c in enumerate(symbols):
            for key, end in ((c, 0), (c + self.mark, _END if self.mark else 0)):
                if key in vocab:
                    text[vocab[key]], self.rank[vocab[key]] = chr(end + b) if end else chr(b), -1
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            made = vocab[(left[: -len(self.mark)] if self.mark and left.endswith(self.mark) else left) + right]
            a, b = vocab[left], vocab[right]
            self.merged[a, b] = rank
            if made not in self.parts and a in text and b in text and self._meet(a, b, rank):
                self.parts[made], self.rank[made], text[made] = (a, b), rank, text[a] + text[b]
        self.automaton = ahocorasick.Automaton()
        for i, t in text.items():
            self.automaton.add_word(t, (i, len(t)))
        self.automaton.make_automaton()
        self.known: dict[int, bool] = {}

    def _meet(self, a: int, b: int, last: int) -> bool:
        """Whether no merge of a rank below `last` joins a's right edge with b's left edge."""
        left, right = [(a, last)], [(b, last)]
        while self.rank[left[-1][0]] >= 0:
            left.append((self.parts[left[-1][0]][1], self.rank[left[-1][0]]))
        while self.rank[right[-1][0]] >= 0:
            right.append((self.parts[right[-1][0]][0], self.rank[right[-1][0]]))
        i, j = len(left) - 1, len(right) - 1
        while i >= 0 and j >= 0:
            (x, ends_x), (y, ends_y) = left[i], right[j]
            rank = self.merged.get((x, y))
            # of equal ranks the leftmost pair merges first: x's own merge goes before, y's after
            if rank is not None and rank < ends_x and (rank <= ends_y if ends_y < last else rank < last):
                return False
            if ends_x <= ends_y:
                i -= 1
                if ends_x == ends_y:
                    j -= 1
            else:
                j -= 1
        return True

    def compatible(self, a: int, b: int) -> bool:
        found = self.known.get(a << 32 | b)
        if found is None:
            if len(self.known) >= self.most_pairs:
                self.known.clear()
            found = self.known[a << 32 | b] = self._meet(a, b, _NEVER)
        return found

    def word(self, word: str) -> tuple[int, ...]:
        """The ids of one piece that the word pattern cut out."""
        raw = word.encode()
        text = raw.decode("latin-1")
        if self.mark:
            text = text[:-1] + chr(_END + raw[-1])
        last: list[tuple[int, int] | None] = [None] * (len(text) + 1)
        for end, (token, size) in self.automaton.iter(text):
            end += 1
            if last[end] is None:
                before = last[end - size]
                if end == size or before is not None and self.compatible(before[0], token):
                    last[end] = (token, size)
        ids, at = [], len(text)
        while at:
            token, size = last[at]
            ids.append(token)
            at -= size
        return tuple(ids[::-1])

    def normal(self, text: str) -> str:
        if self.nfc and not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        if self.lower:
            if "Σ" in text:  # each character is lowered by itself, so no final sigma
                text = text.replace("Σ", "σ")
            text = text.lower()
        return text

    def chunk(self, chunk: str) -> list[int]:
        """The ids of normal text."""
        return [i for word in self.pattern.findall(chunk) for i in self.word(word)]

    def encode(self, text: str | None) -> list[int]:
        """The ids of a whole text; null is empty."""
        out: list[int] = []
        for part, added in self.parts_of(text or ""):
            out += [added] if added is not None else self.chunk(self.normal(part))
        return out

    def parts_of(self, text: str):
        """The text between added tokens, with None, and each added token with its id."""
        if self.added_pattern is None or self.added_mark not in text:
            yield text, None
            return
        for part in self.added_pattern.split(text):
            if part:
                yield part, self.added.get(part)

    def decode(self, ids) -> str:
        """The tokens joined by one space, as this file has no decoder."""
        return " ".join(self.tokens[i] for i in ids)


class _Chunks(dict):
    """Texts between white space -> (number of ids, ids as text, tokens as text, ids as int32 bytes), two generations of bounded size.

    Only the parts that are asked for are made; the others are empty.
    """

    def __init__(self, bpe: WordBpe, as_text: bool, as_tokens: bool, as_bytes: bool, most: int = REMEMBERED_BYTES):
        super().__init__()
        self.bpe, self.old, self.size, self.most, self.wanted = bpe, {}, 0, most, (as_text, as_tokens, as_bytes)

    def __missing__(self, chunk: str):
        found = self.old.get(chunk)
        if found is None:
            found = self.made(self.bpe.chunk(chunk))
        self.size += 400 + len(chunk) + len(found[1]) + len(found[2]) + len(found[3])  # a tuple, its parts and the entry
        if self.size > self.most:
            self.old = dict(self)
            self.clear()
            self.size = 0
        self[chunk] = found
        return found

    def made(self, ids: list[int]):
        as_text, as_tokens, as_bytes = self.wanted
        return len(ids), " ".join(map(str, ids)) if as_text else "", self.bpe.decode(ids) if as_tokens else "", np.array(ids, np.int32).tobytes() if as_bytes else b""


def load(path: str | None = None) -> bytes:
    """The tokenizer file; by default the word-level one of the installed public tokenizers."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, "rb") as f:
        return f.read()


def encode(df: DataFrame, path: str | None = None, text: str = "text", ids: str | None = "ids", decoded: str | None = None, digests: bool = False, keep: list[str] | None = None, remembered: int = REMEMBERED_BYTES) -> DataFrame:
    """df with n_tokens and, as asked for, the ids (array<int>), the decoded text and SHA-256 digests of both.

    The tokenizer file is read on the driver and broadcast (a few MB, whatever the data). Null and empty texts have no
    ids; a text of any length is encoded whole. No shuffle. remembered: bytes of chunks
    that a task keeps, twice; fewer take more time.
    """
    spec = df.sparkSession.sparkContext.broadcast(load(path))
    fields = [T.StructField("n_tokens", T.LongType())]
    fields += [T.StructField(ids, T.ArrayType(T.IntegerType()))] if ids else []
    fields += [T.StructField(decoded, T.StringType())] if decoded else []
    fields += [T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())] if digests else []

    def make():
        bpe = WordBpe(json.loads(spec.value), remembered)
        chunks = _Chunks(bpe, digests, bool(decoded or digests), bool(ids), remembered)
        at = chunks.__getitem__

        def step(texts: pa.Array):
            count, as_bytes, as_text, sha, sha_text = [], [], [], [], []
            for value in texts:
                found: list[tuple[int, str, str, bytes]] = []
                for part, added in bpe.parts_of(value.as_py() or ""):
                    if added is not None:
                        found.append(chunks.made([added]))
                        continue
                    part = bpe.normal(part)
                    found += map(at, [part] if _NOT_SPACE_HERE.search(part) else part.split())
                found = [x for x in found if x[0]]
                count.append(sum([x[0] for x in found]))
                id_text = " ".join([x[1] for x in found]) if digests else ""
                token_text = " ".join([x[2] for x in found]) if decoded or digests else ""
                if ids:
                    as_bytes += [x[3] for x in found]
                if decoded:
                    as_text.append(token_text)
                if digests:
                    sha.append(hashlib.sha256(id_text.encode()).hexdigest())
                    sha_text.append(hashlib.sha256(token_text.encode()).hexdigest())
            out = [pa.array(count, pa.int64())]
            if ids:
                starts = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
                out.append(pa.ListArray.from_arrays(pa.array(starts), pa.array(np.frombuffer(b"".join(as_bytes), np.int32))))
            out += [pa.array(as_text, pa.string())] if decoded else []
            return out + ([pa.array(sha, pa.string()), pa.array(sha_text, pa.string())] if digests else [])

        return step

    return arrow_columns(df, [text], fields, make, keep)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents encoded and decoded: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return encode(docs, ids=None, digests=True, keep=["doc_id"], remembered=REMEMBERED_ALONE)
