"""BPE encoding by tree concatenation, and decoding.

Encoding is local: a sequence of tokens is the encoding of its text as soon as every two
neighbouring tokens are. So the halves of a long text are encoded by themselves, and only tokens at
the join are wrong: a window of ``k`` tokens on each side is encoded again, and grows until it gives
the outermost tokens of both sides back. Then the outer tokens stand as they were, and the window
agrees with both. A window that has swallowed both sides is the whole text, encoded directly.

Where a text has single spaces between words, the tokenizer splits it there anyway, so words are
encoded once each and looked up (see ``tokens``). The tree is for what stays long and unsplit. Texts
over ``PART`` characters are cut into parts that Spark deals out; a document's parts are then joined
in a tree by one task, which holds that document's ids, as its digest needs.

Decoding gathers the bytes of tokens by table, and reads them as UTF-8 with the replacement
character for what is not, as the library does. Nulls and edges: a null text is empty and gives no
ids; special tokens in a text are ids of their own, as the library has it; a null id stays null;
repeated rows are encoded each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalloom.llm.kept import kept
from signalloom.llm.shared import table
from signalloom.llm.tokens import SPACED, Encoder
from signalloom.llm.words import pieces

#: Characters that are encoded at once, and of a part of a long document; tokens of a first window.
LEAF, PART, FIRST_WINDOW = 2_000, 1 << 16, 8


class TokenBytes:
    """The bytes that each token of a byte-level tokenizer stands for."""

    def __init__(self, library):
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        of_char = {chr(b): b for b in visible}
        of_char.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(visible))})
        vocabulary = library.get_vocab(with_added_tokens=True)
        special = {t.content for t in library.get_added_tokens_decoder().values()}
        words = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            words[i] = token.encode() if token in special else bytes(of_char[c] for c in token)
        self.data = np.frombuffer(b"".join(words), dtype=np.uint8)
        self.at = np.concatenate([[0], np.cumsum([len(w) for w in words])])

    def of(self, ids: np.ndarray) -> bytes:
        size = self.at[ids + 1] - self.at[ids]
        out = np.cumsum(size) - size
        return self.data[np.arange(size.sum()) + np.repeat(self.at[ids] - out, size)].tobytes()


def joined(left: np.ndarray, right: np.ndarray, encode: Callable[[str], np.ndarray], token_bytes: TokenBytes) -> np.ndarray:
    """Ids of two texts one after the other, from the ids of each."""
    if not len(left) or not len(right):
        return np.concatenate([left, right])
    k = FIRST_WINDOW
    while True:
        a, b = left[max(0, len(left) - k) :], right[:k]
        whole = len(a) == len(left) and len(b) == len(right)
        try:
            text = token_bytes.of(np.concatenate([a, b])).decode()
        except UnicodeDecodeError:  # the window begins or ends inside a character
            text = None
        if text is not None:
            ids = encode(text)
            # Two tokens of each side must come back, or the side must be in the window to its end.
            from_left = len(a) == len(left) or (ids[:2] == a[:2]).all()
            from_right = len(b) == len(right) or (ids[-2:] == b[-2:]).all()
            if whole or (len(ids) >= 4 and from_left and from_right):
                return np.concatenate([left[: len(left) - len(a)], ids, right[len(b) :]])
        k *= 2


def tree(text: str, encode: Callable[[str], np.ndarray], token_bytes: TokenBytes) -> np.ndarray:
    """Ids of a long text: those of its halves, joined."""
    if len(text) <= LEAF:
        return encode(text)
    half = len(text) // 2
    return joined(tree(text[:half], encode, token_bytes), tree(text[half:], encode, token_bytes), encode, token_bytes)


class TreeEncoder(Encoder):
    """An encoder that takes long unsplit texts apart."""

    def __init__(self, path: str):
        super().__init__(path, SPACED)
        self.token_bytes = TokenBytes(self.library)
        self.one = lambda text: self.each([text])[0]
        self.long_piece = self._long

    def _long(self, text: str) -> np.ndarray:
        return tree(text, self.one, self.token_bytes)


def _of_worker(path: str) -> TreeEncoder:
    return kept(path, lambda: TreeEncoder(path))


RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _result(docs: list, ids: list[np.ndarray], token_bytes: TokenBytes) -> pa.RecordBatch:
    """Count and digest of ids, and the digest of the text decoded from them."""
    numbers = [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids]
    texts = [hashlib.sha256(token_bytes.of(x).decode("utf-8", "replace").encode()).hexdigest() for x in ids]
    columns = [pa.array(docs, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array(numbers, pa.string()), pa.array(texts, pa.string())]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def digests(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id``, ``n_tokens`` and digests of the ids and of the decoded text of each document."""

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _of_worker(path)
        for rows, data, offsets in pieces(batches):
            ids, at = own.encode(data, offsets)
            yield _result(rows.column("doc_id").to_pylist(), np.split(ids, at[1:-1]), own.token_bytes)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _of_worker(path)
        for rows, data, offsets in pieces(batches):
            ids, at = own.encode(data, offsets)
            raw = [x.astype("<u4").tobytes() for x in np.split(ids, at[1:-1])]
            yield pa.RecordBatch.from_arrays([*rows.select(["doc_id", "of", "part"]).columns, pa.array(raw, pa.binary())], ["doc_id", "of", "part", "ids"])

    def whole(key, rows):
        own = _of_worker(path)
        rows = rows.sort_by("part")
        at, ids = rows.column("part").to_numpy(), rows.column("ids").to_pylist()
        # Repeated rows bring each part as often.
        parts = [np.frombuffer(ids[i], dtype="<u4") for i in np.unique(at, return_index=True)[1]]
        while len(parts) > 1:
            parts = [joined(*parts[i : i + 2], own.one, own.token_bytes) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        again = int((at == 0).sum())
        return pa.Table.from_batches([_result([key[0].as_py()] * again, parts * again, own.token_bytes)])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    is_long = F.length("text") > PART
    start = F.sequence(F.lit(1), F.length("text"), F.lit(PART))
    dealt = texts.where(is_long).select(
        "doc_id", F.xxhash64("text").alias("of"), F.posexplode(F.transform(start, lambda i: F.substring("text", i, F.lit(PART)))).alias("part", "text")
    ).repartition("doc_id", "of", "part")
    long = dealt.mapInArrow(part, "doc_id long, of long, part int, ids binary").groupBy("doc_id", "of").applyInArrow(whole, RESULT)
    return texts.where(~is_long).mapInArrow(short, RESULT).unionByName(long)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
