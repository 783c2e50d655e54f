"""Encoding of whole texts with a public byte-pair tokenizer.

Texts are encoded batch by batch where they lie, without a shuffle. A long stretch that the tokenizer's
pattern doesn't split (one word, one run of blanks) is the slow and memory-hungry case of byte-pair
merging; it is encoded as a tree: halves down to leaves are encoded on their own, in parallel, and joined
two by two. At a join the tokens around the seam are encoded anew in a window that grows until its first
token and its last are those that the two sides already have there. Since a sequence of tokens is the
encoding of its text exactly if every two neighbours are the encoding of theirs, the result is exact.

Texts beyond `part_chars` are cut into parts which different tasks encode. Parts end where the pattern
splits; only a stretch that is longer than a part is cut inside, and its parts are joined like the leaves.
Blanks before a long stretch are encoded piece by piece as the whole text has them, since what follows decides how blanks are split.

Defined cases: null and empty texts give an empty list; strings of special tokens are ordinary text; lone
surrogates can't occur in Spark strings. Repeated rows give repeated results.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import os
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER_DIR = "/opt/tokenizers"
# Fixed value: the pattern by which the public byte-level tokenizers split text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A stretch without a split of more characters than this is encoded as a tree, down to leaves of half of it.
UNSPLIT_CHARS = 4096
#: Texts of more characters are encoded by several tasks.
PART_CHARS = 1 << 20

IDS = pa.list_(pa.int32())


@lru_cache(maxsize=8)
def encoder(name: str, folder: str = TOKENIZER_DIR):
    """The tokenizer `name`, one of the byte-level vocabularies kept as ranks in `folder`."""
    import tiktoken

    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


# The same for Python, whose own notion of white space is wider than the tokenizers'.
_SPLIT = regex.compile(PATTERN.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}"))


@lru_cache(maxsize=2)
def _long_stretch(chars: int):
    return regex.compile(rf"\S{{{chars},}}|\p{{White_Space}}{{{chars},}}")


def _bytes_of(enc, tokens: list[int]) -> bytes:
    return enc.decode_bytes(tokens)


def _encode_piece(enc, piece: bytes) -> list[int]:
    """Tokens of bytes that count as one unsplit piece."""
    return enc._encode_single_piece(piece)


def join(enc, left: list[int], right: list[int]) -> list[int]:
    """The encoding of the text of `left` followed by that of `right`, both being encodings of one piece's parts."""
    if not left or not right:
        return left + right
    i = j = 1
    while True:
        i, j = min(i, len(left)), min(j, len(right))
        middle = _encode_piece(enc, _bytes_of(enc, left[-i:] + right[:j]))
        good_left = i == len(left) or middle[0] == left[-i]
        good_right = j == len(right) or middle[-1] == right[j - 1]
        # With two tokens at least, the outermost pairs on either side are pairs of a valid encoding.
        if good_left and good_right and (len(middle) > 1 or (i == len(left) and j == len(right))):
            return left[: len(left) - i] + middle + right[j:]
        i, j = (i if good_left else 2 * i), (j if good_right else 2 * j)
        if good_left and good_right:
            i, j = 2 * i, 2 * j


def encode_tree(enc, piece: bytes, leaf: int, pool: ThreadPoolExecutor | None = None) -> list[int]:
    """The encoding of one unsplit piece: leaves of `leaf` bytes are encoded in parallel, then joined as a tree."""
    parts = [piece[k : k + leaf] for k in range(0, len(piece), leaf)]
    run = pool.map if pool else map
    level = list(run(lambda p: _encode_piece(enc, p), parts))
    while len(level) > 1:
        pairs = [(level[k], level[k + 1] if k + 1 < len(level) else []) for k in range(0, len(level), 2)]
        level = list(run(lambda p: join(enc, *p), pairs))
    return level[0] if level else []


def encode(enc, text: str | None, unsplit: int = UNSPLIT_CHARS, pool: ThreadPoolExecutor | None = None) -> list[int]:
    """Token ids of a whole text."""
    if not text:
        return []
    if len(text) < unsplit or not _long_stretch(unsplit).search(text):
        return enc.encode_ordinary(text)
    ids: list[int] = []
    done = end = 0
    blanks: list[str] = []
    for m in _SPLIT.finditer(text):
        if m.end() - m.start() >= unsplit:
            ids += enc.encode_ordinary(text[done:end]) if end > done else []
            # Cut off from what follows, blanks would be split otherwise than in the whole text.
            ids += itertools.chain.from_iterable(_encode_piece(enc, b.encode()) for b in blanks)
            ids += encode_tree(enc, m.group().encode(), unsplit // 2, pool)
            done = end = m.end()
            blanks = []
        elif m.group()[-1].isspace():
            blanks.append(m.group())
        else:
            end = m.end()
            blanks = []
    return ids + (enc.encode_ordinary(text[done:]) if done < len(text) else [])


def parts(text: str, size: int) -> Iterator[tuple[str, int]]:
    """Parts of a long text, and for each the number of the stretch it is or is cut out of, -1 for a part that ends where the pattern splits."""
    start = end = 0
    blanks: list[tuple[str, int]] = []
    for number, m in enumerate(_SPLIT.finditer(text)):
        if m.end() - m.start() > size:
            if end > start:
                yield text[start:end], -1
            yield from blanks
            for k in range(m.start(), m.end(), size):
                yield text[k : min(k + size, m.end())], number
            start = end = m.end()
            blanks = []
            continue
        if m.end() - start > size and end > start:
            yield text[start:end], -1
            start = end
        if m.group()[-1].isspace():  # what follows decides how blanks are split, so no part ends with them
            blanks.append((m.group(), number))
        else:
            end = m.end()
            blanks = []
    if start < len(text):
        yield text[start:], -1


def _batches(name: str, folder: str, unsplit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(name, folder)
        with ThreadPoolExecutor(2) as pool:
            for batch in batches:
                lists = [encode(enc, t, unsplit, pool) for t in batch.column(1).to_pylist()]
                offsets = np.zeros(len(lists) + 1, dtype=np.int32)
                np.cumsum([len(x) for x in lists], out=offsets[1:])
                flat = np.empty(int(offsets[-1]), dtype=np.int32)
                for k, x in enumerate(lists):
                    flat[offsets[k] : offsets[k + 1]] = x
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["doc_id", "ids"])

    return run


def token_ids(docs: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR, unsplit: int = UNSPLIT_CHARS, part_chars: int = PART_CHARS) -> DataFrame:
    """`(doc_id bigint, ids array<int>)` for each row of `docs(doc_id, text)`.

    A column `n_chars`, if there is one, tells which texts are long without reading them; one that is wrong or null costs
    time, not exactness.
    """
    size = F.col("n_chars") if "n_chars" in docs.columns else F.length("text")
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", size.alias("__size"))
    schema = "doc_id bigint, ids array<int>"
    long = F.coalesce(F.col("__size") > part_chars, F.lit(False))
    if docs.where(long).limit(1).count() == 0:
        return docs.drop("__size").mapInArrow(_batches(tokenizer, folder, unsplit), schema)
    short = docs.where(~long).drop("__size").mapInArrow(_batches(tokenizer, folder, unsplit), schema)
    return short.unionByName(_in_parts(docs.where(long), tokenizer, folder, unsplit, part_chars))


def _in_parts(docs: DataFrame, name: str, folder: str, unsplit: int, part_chars: int) -> DataFrame:
    """The same for very long texts: parts are dealt to tasks, and each document's parts are joined again.

    What comes together is the ids of one document, which are one value of the result. Repeated documents are told apart by a row number.
    """

    def cut(batches):
        for batch in batches:
            for row, doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                for no, (part, stretch) in enumerate(parts(text, part_chars)):
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((row, pa.int64()), (doc, pa.int64()), (no, pa.int32()), (stretch, pa.int32()), (part, pa.string()))], names=["row", "doc_id", "no", "stretch", "text"])

    def encode_parts(batches):
        enc = encoder(name, folder)
        for batch in batches:
            for row, doc, no, stretch, text in zip(*(c.to_pylist() for c in batch.columns)):
                ids = encode(enc, text, unsplit) if stretch < 0 else encode_tree(enc, text.encode(), unsplit // 2)
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((row, pa.int64()), (doc, pa.int64()), (no, pa.int32()), (stretch, pa.int32()), (ids, IDS))], names=["row", "doc_id", "no", "stretch", "ids"])

    def put_together(group: pa.Table) -> pa.Table:
        enc = encoder(name, folder)
        rows = sorted(zip(*(group.column(c).to_pylist() for c in ("no", "stretch", "ids", "doc_id"))))
        done: list[int] = []
        for stretch, run in itertools.groupby(rows, key=lambda r: r[1]):
            level = [r[2] for r in run]
            if stretch < 0:
                done += itertools.chain.from_iterable(level)
                continue
            while len(level) > 1:
                level = [join(enc, level[k], level[k + 1] if k + 1 < len(level) else []) for k in range(0, len(level), 2)]
            done += level[0]
        return pa.table({"doc_id": pa.array([rows[0][3]], pa.int64()), "ids": pa.array([done], IDS)})

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    cuts = numbered.mapInArrow(cut, "row bigint, doc_id bigint, no int, stretch int, text string").repartition("row", "no")
    encoded = cuts.mapInArrow(encode_parts, "row bigint, doc_id bigint, no int, stretch int, ids array<int>")
    return encoded.groupBy("row").applyInArrow(put_together, "doc_id bigint, ids array<int>")


def compared(docs: DataFrame, ids: DataFrame, tokenizer: str, folder: str = TOKENIZER_DIR) -> DataFrame:
    """`(doc_id, text_md5, same)`: the digest of the text that the ids stand for, and whether the tokenizer gives the same ids for the text as a whole; both null for a null text.

    Texts and ids meet by `doc_id`, which must be unique.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, folder)
        for batch in batches:
            doc, text, found = (c.to_pylist() for c in batch.columns)
            digest = [hashlib.md5(enc.decode_bytes(i or [])).hexdigest() if t is not None else None for t, i in zip(text, found)]
            same = [enc.encode_ordinary(t) == i if t is not None else None for t, i in zip(text, found)]
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(digest, pa.string()), pa.array(same, pa.bool_())], names=["doc_id", "text_md5", "same"])

    both = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(ids, "doc_id", "left")
    return both.select("doc_id", "text", "ids").mapInArrow(run, "doc_id bigint, text_md5 string, same boolean")
