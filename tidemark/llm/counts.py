"""Token counts with a digest cache.

The cache is a table (tokenizer, digest, n_tokens): the digest of a tokenizer's file and library, the SHA-256 of a normalised text and its
count. Rows meet the cache by digest; only distinct texts that it lacks are encoded, once each, and their counts are appended to it. All
counts are then read from the cache. A second run over the same texts encodes nothing and moves no text.
"""

from __future__ import annotations

import hashlib
import importlib.metadata
import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, mapped, shared_path, whole, written
from .pieces import ENDS, Memo, pieces

LIMIT = 4096
#: Segments that a worker remembers in each of two generations.
REMEMBERED = 400_000
#: Up to so many digests (32 bytes each) a list of texts to encode goes to all tasks, and no other text is shuffled.
BROADCAST_ROWS = 100_000
#: The mark that sentencepiece writes for a space.
MARK = "▁"
SEGMENT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def wire(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """(field, value) of a message in protocol-buffer wire format: numbers of kind 0, bytes of kinds 1, 2 and 5."""
    at = 0

    def number() -> int:
        nonlocal at
        n = shift = 0
        while True:
            b = data[at]
            at += 1
            n |= (b & 127) << shift
            shift += 7
            if b < 128:
                return n

    while at < len(data):
        key = number()
        size = {0: 0, 1: 8, 5: 4}.get(key & 7)
        value = number() if key & 7 in (0, 2) else None
        size = value if size is None else size
        if key & 7:
            value, at = data[at : at + size], at + size
        yield key >> 3, value


def by_segments(proto: bytes) -> bool:
    """Whether a sentencepiece model encodes a text as its segments one by one: BPE without a rule that rewrites characters or drops white
    space, and no piece in which a mark follows another character, so no merge crosses the begin of a segment."""
    kind, normal, whole_words = 1, {}, True
    for field, value in wire(proto):
        if field == 1:
            piece = dict(wire(value))
            text = piece[1].decode()
            whole_words &= piece.get(3, 1) in (1, 2, 3, 6) and not re.search(f"[^{MARK}]{MARK}", text)  # no user-defined or unused pieces
        elif field == 2:
            trained = dict(wire(value))
            kind = trained.get(3, 1)
            whole_words &= not trained.get(24, 0)
        elif field == 3:
            normal = dict(wire(value))
    plain = not normal.get(2) and normal.get(3, 1) == 1 and normal.get(4, 1) == 0 and normal.get(5, 1) == 1
    return kind == 2 and whole_words and plain


class SentencePieces:
    """Counts the pieces of texts; segments (a word with the spaces before it) are remembered. A model that by_segments() doesn't know encodes whole texts."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.whole = not by_segments(self.model.serialized_model_proto())
        self.lone = len(self.model.encode("a ")) - len(self.model.encode("a"))  # a mark of its own
        self.joined = set()  # characters that stand beside each other in some piece
        for i in range(0 if self.whole else self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            self.joined.update(zip(piece, piece[1:]))
        self.word = Memo(self._learn, REMEMBERED)

    def _learn(self, word: str) -> int:
        """Pieces of a word behind one mark, which the model puts before it. A last character that no piece joins to the one before is apart."""
        if len(word) > 1 and word[-1] in ENDS and tuple(word[-2:]) not in self.joined:
            return self.word[word[:-1]] + 1
        return len(self.model.encode(word)) if word else self.lone

    def count(self, text: str) -> int:
        if self.whole or not text:
            return len(self.model.encode(text))
        text = text.replace(MARK, " ")
        if "  " in text or text[0] == " " or text[-1] == " ":
            return sum(self.word[s[1:].replace(MARK, " ")] for s in SEGMENT.findall(MARK + text.replace(" ", MARK)))
        return sum(map(self.word.__getitem__, text.split(" ")))


_held: dict[str, SentencePieces] = {}


def counter(path: str):
    """The worker's counting function for this vocabulary: `.model` by sentencepiece, others by tokenizers."""
    if not path.endswith(".model"):
        encoder = pieces(path)
        return lambda text: len(encoder.ids(text)) // 4
    if path not in _held:
        _held[path] = SentencePieces(path)
    return _held[path].count


def version_of(path: str) -> str:
    """Digest of a tokenizer: its file, and the library with its version."""
    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    return hashlib.sha256(Path(path).read_bytes() + f"\n{library} {importlib.metadata.version(library)}".encode()).hexdigest()


def content(text: str) -> Column:
    """What a tokenizer sees of a text: null as empty, broken UTF-8 repaired."""
    return F.make_valid_utf8(whole(text))


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([count(t.as_py()) for t in batch.column(1)], pa.int64())], names=["digest", "n_tokens"])

    return run


def cached(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """(digest, n_tokens) of one tokenizer in the cache; empty where there is none. Digests that two writers appended count once."""
    schema = "digest binary, n_tokens long, tokenizer string"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(cache)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema).select("digest", "n_tokens")
    return spark.read.schema(schema).parquet(cache).filter(F.col("tokenizer") == version).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


def misses(keyed: DataFrame, known: DataFrame) -> DataFrame:
    """The distinct digests that the cache lacks, as a table."""
    return written(keyed.select("digest").distinct().join(known, "digest", "left_anti"), "misses")


def token_counts(docs: DataFrame, tokenizer: str, cache: str | None = None, text: str = "text", keep: list[str] | None = None, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Rows of docs (columns `keep`, all by default) with n_bytes (UTF-8) and n_tokens of the whole text, without begin, end or added tokens.

    `tokenizer` is the path of a vocabulary, the same on all machines. `cache` is a folder that all executors reach (a new one under
    spark.checkpoint.dir by default); the call appends what it lacks. Null texts count as empty: no bytes, no tokens. Repeated rows stay and are
    encoded once. A column named like a result is kept, and the result takes the name with "_" before it. An empty table gives none. A lost
    executor costs its tasks alone; a broken append leaves no rows, and the next run encodes them. The texts to encode are shuffled once, each
    task's copies folded before; where the cache has all but `broadcast_rows` texts, only those."""
    spark = docs.sparkSession
    cache = cache or shared_path(spark, "token-counts")
    version = version_of(tokenizer)
    kept = docs.columns if keep is None else keep
    n_bytes, n_tokens = fresh(docs.select(*kept), "n_bytes", "n_tokens")
    names = [f"c{i}" for i in range(len(kept))]
    digest = F.unhex(F.sha2(content(text).cast("binary"), 256))
    rows = docs.select(*(F.col(c).alias(n) for c, n in zip(kept, names, strict=True)), F.octet_length(whole(text)).cast("long").alias("n_bytes"), digest.alias("digest"))
    keyed = written(rows, "digests")
    known = cached(spark, cache, version)
    lacking = misses(keyed, known)
    lacks = lacking.count()
    if lacks:
        texts = docs.select(digest.alias("digest"), content(text).alias("content"))
        texts = texts.join(F.broadcast(lacking), "digest", "left_semi") if lacks <= broadcast_rows else texts
        distinct = texts.groupBy("digest").agg(F.first("content").alias("content"))
        distinct = distinct if lacks <= broadcast_rows else distinct.join(lacking, "digest", "left_semi")
        counted = mapped(distinct.select("digest", "content"), _encoded(tokenizer), "digest binary, n_tokens long")
        counted.withColumn("tokenizer", F.lit(version)).write.mode("append").partitionBy("tokenizer").parquet(cache)
    # a table of its own on this side of the join lets Spark split the rows of a hot digest on the other
    counts = written(cached(spark, cache, version).join(keyed.select("digest").distinct(), "digest", "left_semi"), "counts")
    out = keyed.join(counts, "digest").select(*names, "n_bytes", "n_tokens")
    return out.toDF(*kept, n_bytes, n_tokens)


def op11_token_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    counted = token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"])
    return counted.withColumn("over_limit", F.col("n_tokens") > LIMIT)
