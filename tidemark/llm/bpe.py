"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over the last 32 characters cuts each text where the hash's low bits are zero, so texts that share
a passage share its inner chunks wherever the passage begins. A worker encodes a chunk once and keeps the ids. A cut
may fall inside a word, so each join is repaired: a window of the last words before the cut and the first behind
it is encoded as one text, and must agree with its neighbours' ids at both ends; where it does not, the window grows, at last to
the whole text. A text without a cut is one chunk and goes through the same memo. The job only scans: no row moves, and an executor that is lost repeats its own tasks alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, mapped
from .pieces import Pieces, pieces

MASK_BITS = 11
LEAST = 512
#: Pieces at each end of a chunk that a join's window takes in, and the fewest a chunk may have.
EDGE, FEWEST = 2, 6
#: Characters of chunks that a worker keeps in each of two generations.
KEPT = 2_000_000
#: Words that a worker remembers in each of two generations.
REMEMBERED = 100_000


def cuts(text: str, mask_bits: int = MASK_BITS, least: int = LEAST) -> list[int]:
    """Where chunks end, the text's end included. The hash after position i depends on characters i-31..i alone."""
    if len(text) < 2 * least:
        return [len(text)]
    h = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4") * np.uint32(2654435761)
    h ^= h >> np.uint32(15)
    for step in (1, 2, 4, 8, 16):
        shifted = np.zeros_like(h)
        shifted[step:] = h[:-step] * np.uint32(pow(0x9E3779B1, step, 2**32))
        h = h + shifted
    out, last = [], 0
    for i in np.flatnonzero((h >> np.uint32(32 - mask_bits)) == 0) + 1:
        if i - last >= least and len(text) - i >= least:
            out.append(int(i))
            last = i
    return [*out, len(text)]


class Chunks:
    """Encodes texts chunk by chunk; the memo's two generations bound its memory."""

    def __init__(self, enc: Pieces, kept: int = KEPT, mask_bits: int = MASK_BITS, least: int = LEAST):
        self.enc, self.kept, self.mask_bits, self.least = enc, kept, mask_bits, least
        self.young, self.old, self.size = {}, {}, 0
        self.encoded = self.reused = self.repaired = self.characters_reused = 0

    def chunk(self, text: str) -> tuple:
        """Head text, its ids, those of its last piece, inner ids, tail ids, those of its first piece, tail text; a chunk of few pieces is all head."""
        if got := self.young.get(text) or self.old.get(text):
            self.reused += 1
            self.characters_reused += len(text)
        else:
            self.encoded += 1
            got = self._ends(text)
        if text not in self.young:
            if self.size > self.kept:
                self.old, self.young, self.size = self.young, {}, 0
            self.young[text] = got
            self.size += len(text)
        return got

    def _ends(self, text: str) -> tuple:
        parts = [] if self.enc.whole else self.enc.split(text)
        if len(parts) < FEWEST:
            return text, self.enc.ids(text), b"", b"", b"", b"", ""
        ids = self.enc.encode(parts)
        at = 0
        for p in parts[:EDGE]:
            at = text.index(p, at) + len(p)
        back = len(text)
        for p in parts[: -EDGE - 1 : -1]:
            back = text.rindex(p, 0, back)
        return text[:at], b"".join(ids[:EDGE]), ids[EDGE - 1], b"".join(ids[EDGE:-EDGE]), b"".join(ids[-EDGE:]), ids[-EDGE], text[back:]

    def pieces_of(self, text: str) -> list[str]:
        """Chunks of a text; one with too few pieces for a join at either end goes on into the next."""
        if self.enc.whole:
            return [text]
        out, start, ends = [], 0, cuts(text, self.mask_bits, self.least)
        for end in ends:
            part = text[start:end]
            if end == ends[-1] or len(self.enc.split(part[:400])) >= FEWEST:
                out.append(part)
                start = end
        if len(out) > 1 and len(self.enc.split(out[-1])) < FEWEST:
            out[-2:] = ["".join(out[-2:])]
        return out

    def joined(self, left: str, right: str) -> bytes | None:
        """The ids of two neighbouring chunks, their join repaired by a window that grows until it agrees with the chunks' own ids at both ends.

        None if no window inside them agrees: then the join's ids hang on more than these two chunks."""
        a, b = self.enc.split(left), self.enc.split(right)
        ia, ib, edge = self.enc.encode(a), self.enc.encode(b), 2 * EDGE
        while edge < min(len(a), len(b)):
            at, back = 0, len(left)
            for p in b[:edge]:
                at = right.index(p, at) + len(p)
            for p in a[: -edge - 1 : -1]:
                back = left.rindex(p, 0, back)
            window = self.enc.library([left[back:] + right[:at]])[0]
            self.repaired += 1
            if window.startswith(ia[-edge]) and window.endswith(ib[edge - 1]):
                return b"".join([*ia[:-edge], window, *ib[edge:]])
            edge *= 2
        return None

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of whole texts. The windows of all their joins go to the library at once; where one does not agree with both its
        neighbours, growing windows follow (see joined), over two chunks that count as one from then on, and the whole text at last."""
        held = [[self.chunk(p) for p in self.pieces_of(t)] for t in texts]
        windows = [a[6] + b[0] for cs in held for a, b in zip(cs, cs[1:], strict=False)]
        self.repaired += len(windows)
        repaired = iter(self.enc.library(windows))
        out = []
        for text, cs in zip(texts, held, strict=True):
            ids, agreed = [cs[0][1], cs[0][3]], True
            for a, b in zip(cs, cs[1:], strict=False):
                window = next(repaired)
                agreed &= window.startswith(a[5]) and window.endswith(b[2])
                ids += [window, b[3]]
            out.append(b"".join([*ids, cs[-1][4]]) if agreed else self.regrown(text))
        return out

    def regrown(self, text: str) -> bytes:
        """The ids of a text with a join that the first window could not repair."""
        parts = self.pieces_of(text)
        left, ids = parts[0], None
        for right in parts[1:]:
            ids = self.joined(left, right)
            if ids is None:
                return self.enc.library([text])[0]
            left += right
        return self.enc.ids(text) if ids is None else ids


_held: dict[str, tuple] = {}


def _worker(path: str) -> tuple[Chunks, pa.Array | None]:
    """The worker's encoder, and its tokens where the tokenizer has no decoder of its own and so joins them by a space."""
    if path not in _held:
        enc = pieces(path, REMEMBERED)
        tokens = None
        if enc.tokenizer.decoder is None:
            size = max(enc.tokenizer.get_vocab(with_added_tokens=True).values()) + 1
            tokens = pa.array([enc.tokenizer.id_to_token(i) or "" for i in range(size)])
        _held[path] = Chunks(enc), tokens
    return _held[path]


def _coded(path: str, at: int, keep: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, tokens = _worker(path)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                got = chunks.encode([t or "" for t in part.column(at).to_pylist()])
                ends = pa.array(np.cumsum([0, *(len(g) // 4 for g in got)]).astype("i4"))
                ids = pa.array(np.frombuffer(b"".join(got), "<i4"))
                lists = pa.ListArray.from_arrays(ends, ids)
                if tokens is not None:
                    text = pc.binary_join(pa.ListArray.from_arrays(ends, tokens.take(ids)), " ")
                else:
                    text = pa.array(chunks.enc.tokenizer.decode_batch(lists.to_pylist(), skip_special_tokens=False), pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), lists, text], names=[*(f"c{k}" for k in keep), "ids", "decoded"])

    return run


def encode_decode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """Every row of docs with `ids` (array<int>) of its whole text and `decoded`, the text of those ids.

    keep: the columns of docs that stay, all by default. Null and empty texts have no ids and decode to an empty
    text. Rows repeat as they come; a column that is named as a result already is kept, and the result takes the
    name with "_" before it. An empty table gives an empty one."""
    kept = [docs.columns.index(c) for c in (docs.columns if keep is None else keep)]
    rows = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    ids, decoded = fresh(docs.select(*(docs.columns[k] for k in kept)), ids, decoded)
    schema = ", ".join([*(f"c{k} {docs.schema.fields[k].dataType.simpleString()}" for k in kept), "ids array<int>", "decoded string"])
    return mapped(rows, _coded(path, docs.columns.index(text), kept), schema).toDF(*(docs.columns[k] for k in kept), ids, decoded)


def op1_bpe_chunks(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    """Digests of the ids and of the decoded text of every document."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    coded = encode_decode(docs, path or public_tokenizers.path("word_bpe_49k.json"), keep=["doc_id"])
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
