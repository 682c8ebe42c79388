"""Token counts by a public tokenizer, with overlap resynchronisation for huge texts.

A text of at most ``chunk`` characters is encoded whole. A longer one is encoded
in chunks that overlap; two neighbouring encodings are spliced at a position in
their overlap where both have a token start and which is proven stable: a white
space character (blank or line feed) after a character that is not white space.
No pre-token of these tokenizers runs over such a place, so what stands left of
it and right of it is encoded independently. If the overlap holds no such place,
it is widened, in the worst case to the rest of the text.

Within a text that is encoded whole, pieces between such places are counted once a
worker; simple pieces through ``tiktoken`` with the file's own vocabulary, which gives the
same tokens as ``tokenizers`` (tests compare both), all others through ``tokenizers``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: White space that some regex library may see otherwise than Python does.
ODD_SPACE = re.compile(r"[^\S \n]|[\x1c-\x1f]")
PIECE = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
#: Entries of a worker's memory of piece -> count; it is emptied when full.
MEMORY = 400_000
#: A piece of one or two pre-tokens that all Unicode versions see alike: Latin-1 letters after at most a blank, then at most one mark.
SIMPLE = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]?)")


def single_piece(vocab: dict[str, int], merges: list):
    """``tiktoken``'s encoder of one pre-token over a byte-level vocabulary, or None if ids aren't in merge order."""
    import tiktoken

    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(kept)]
    byte_of = {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}
    merged = [vocab.get("".join(m if isinstance(m, list) else m.split(" "))) for m in merges]
    if None in merged or merged != sorted(merged) or min(merged, default=0) < 256:
        return None
    ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items() if all(c in byte_of for c in t)}
    return tiktoken.Encoding("pieces", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece


class JsonEncoder:
    """A ``tokenizers`` file. Byte-level files count by pieces that are cut at stable places."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        self.inner.no_padding()
        self.inner.no_truncation()
        spec = json.loads(open(path, encoding="utf-8").read())
        pre = spec.get("pre_tokenizer") or {}
        plain = all(not t["lstrip"] and not t["rstrip"] and not ODD_SPACE.search(t["content"]) and " " not in t["content"] and "\n" not in t["content"] for t in spec["added_tokens"])
        self.by_piece = plain and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and spec.get("normalizer") is None and spec.get("post_processor") is None
        self.memory: dict[str, int] = {}
        self.single = single_piece({t: i for t, i in spec["model"]["vocab"].items() if t not in {a["content"] for a in spec["added_tokens"]}}, spec["model"]["merges"]) if self.by_piece else None

    def starts(self, text: str) -> list[int]:
        return [s for s, _ in self.inner.encode(text, add_special_tokens=False).offsets]

    def counts(self, texts: list[str]) -> list[int]:
        if not self.by_piece:
            return [len(e.ids) for x in range(0, len(texts), 64) for e in self.inner.encode_batch_fast(texts[x : x + 64], add_special_tokens=False)]
        return [self._count(t) for t in texts]

    def _count(self, text: str) -> int:
        if ODD_SPACE.search(text):
            return len(self.inner.encode(text, add_special_tokens=False))
        pieces, memory = PIECE.findall(text), self.memory
        got = list(map(memory.get, pieces))
        if None in got:
            new = list({p for p, n in zip(pieces, got, strict=True) if n is None})
            if len(memory) + len(new) > MEMORY:
                memory.clear()
                new = list(set(pieces))
            others = []
            for p in new:
                m = SIMPLE.fullmatch(p) if self.single else None
                if m:
                    memory[p] = sum(len(self.single(x.encode())) for x in m.groups() if x)
                else:
                    others.append(p)
            memory.update(zip(others, map(len, self.inner.encode_batch_fast(others, add_special_tokens=False)), strict=True))
            got = map(memory.__getitem__, pieces)
        return sum(got)


class PieceEncoder:
    """A ``sentencepiece`` model."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.inner = SentencePieceProcessor(model_file=path)

    def starts(self, text: str) -> list[int]:
        return [p.begin for p in self.inner.encode(text, out_type="immutable_proto").pieces]

    def counts(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.inner.encode(texts, num_threads=1)]


_encoders: dict[str, JsonEncoder | PieceEncoder] = {}


def encoder(path: str) -> JsonEncoder | PieceEncoder:
    """One encoder a worker and file."""
    if path not in _encoders:
        _encoders[path] = (JsonEncoder if path.endswith(".json") else PieceEncoder)(path)
    return _encoders[path]


def stable(text: str, at: int) -> bool:
    """Whether no token of any longer text can run over ``at``."""
    return 0 < at < len(text) and text[at] in " \n" and not text[at - 1].isspace() and text[at - 1] not in "\x1c\x1d\x1e\x1f"


def count_spliced(starts, text: str, chunk: int, overlap: int) -> int:
    """Tokens of ``text`` from encodings of overlapping chunks; ``starts(part)`` gives token starts."""
    n, total, begin, counted = len(text), 0, 0, 0
    while True:
        end, lap = min(n, begin + chunk), overlap
        left = starts(text[begin:end])
        while end < n:
            nxt = max(begin, end - lap)
            right = {nxt + s for s in starts(text[nxt : min(n, nxt + chunk)])}
            common = [at for s in left if (at := begin + s) > max(nxt, counted) and at in right and stable(text, at)]
            if common:
                break
            # no proven place: a wider overlap, and a longer chunk if it already spans all of this one
            lap *= 2
            if end - lap <= begin:
                end = min(n, end + lap)
                left = starts(text[begin:end])
        total += sum(1 for s in left if begin + s >= counted and (end == n or begin + s < common[-1]))
        if end == n:
            return total
        counted, begin = common[-1], nxt


def count_tokens(docs: DataFrame, tokenizer: str, *, limit: int = 512, chunk: int = 32_768, overlap: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, ``n_bytes``, ``n_tokens``, ``over_limit`` (``n_tokens > limit``).

    ``tokenizer`` is the path of a .json or .model file that every executor has.
    Null and empty texts have 0 bytes and tokens; repeated rows and null ids stay as
    they are; other columns are ignored; an empty table gives no rows. One pass
    over the table without a shuffle; a worker holds one text and its counts by piece.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            tokens = np.zeros(batch.num_rows, np.int64)
            sizes = np.zeros(batch.num_rows, np.int64)
            column = batch.column(1)
            for first in range(0, batch.num_rows, 256):
                texts = [t or "" for t in column.slice(first, 256).to_pylist()]
                sizes[first : first + len(texts)] = [len(t) if t.isascii() else len(t.encode()) for t in texts]
                short = [i for i, t in enumerate(texts) if len(t) <= chunk]
                tokens[[first + i for i in short]] = enc.counts([texts[i] for i in short])
                for i, t in enumerate(texts):
                    if len(t) > chunk:
                        tokens[first + i] = count_spliced(enc.starts, t, chunk, overlap)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(tokens), pa.array(tokens > limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
