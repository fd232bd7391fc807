"""Phrase collocations from one FM-index a shard.

A shard is a bounded part of one language's words, numbered by the shard's own vocabulary, with 0 between pieces. Its index is the
Burrows-Wheeler transform of these numbers, sorted to as many words as a phrase may have. The interval of a phrase is extended to the left by
the transform and to the right by the interval it lies in: the interval of a P b lies inside that of a P and comes from that of P b.
All intervals of one depth are extended together, level by level; each has its count in the shard, and how many of its occurrences have a
word of the piece at the left and at the right.

Counts are summed across shards by phrase. A level extends only phrases that are frequent in the whole language: of each shard the
intervals of those go back to its index, and a longer phrase is looked at where both phrases inside it are among them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import mapped, whole, written

LEAST, WORDS, TOP = 30, 4, 2000
SHARD_WORDS = 3 << 20
#: Rows of an Arrow batch.
ROWS = 100_000
#: Parts in which a language's candidates are put in order before the last step, which sees SALTS * TOP rows of a language at most.
SALTS = 64
# Marks and line ends that end a piece; words stand between spaces and tabs.
_LETTERS, _ENDS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b".,;:!?\n\x0b\x0c\r"
#: A byte that UTF-8 never has stands for the end of a piece.
END = b"\xff"
_LOWER = bytes.maketrans(_LETTERS + _ENDS, _LETTERS.lower() + END * len(_ENDS))
_SPACED = b" " + END + b" "


class Vocabulary(dict):
    """Numbers words as they come; 0 ends a piece."""

    def __init__(self):
        super().__init__({END: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def numbered(text: bytes, vocabulary: Vocabulary) -> np.ndarray:
    """The words of a text, with 0 behind each piece."""
    words = text.translate(_LOWER).replace(END, _SPACED).split()
    words.append(END)
    return np.fromiter(map(vocabulary.__getitem__, words), np.int32, len(words))


def by_symbol(x: np.ndarray) -> np.ndarray:
    """Stable order of small whole numbers, by 16 bits at a time (which numpy sorts by radix)."""
    order = np.argsort(x.astype(np.uint16), kind="stable")
    if len(x) and x.max() >= 1 << 16:
        order = order[np.argsort((x[order] >> 16).astype(np.uint16), kind="stable")]
    return order


def transform(words: np.ndarray, depth: int = WORDS) -> np.ndarray:
    """The Burrows-Wheeler transform of words (0 at the end), with suffixes in the order of their first `depth` words."""
    order = np.arange(len(words))
    for _ in range(depth):
        order = order[by_symbol(words[order - 1])] - 1
        order[order < 0] += len(words)
    return words[order - 1]


class Index:
    """Intervals of an index, level by level."""

    def __init__(self, bwt: np.ndarray):
        self.bwt = bwt
        self.source = by_symbol(bwt)  # where the rest of each suffix stands
        self.first = bwt[self.source]
        self.size = 1
        self.heads = self._heads(self.first)
        self.valid = self.first != 0
        self.rest = self.source  # where what follows the phrase stands

    @staticmethod
    def _heads(x: np.ndarray) -> np.ndarray:
        return np.r_[True, x[1:] != x[:-1]] if len(x) else np.zeros(0, bool)

    def extend(self) -> None:
        """To phrases of one word more: a word to the left of each interval."""
        inner = np.cumsum(self.heads)[self.source]
        self.heads = self._heads(self.first) | self._heads(inner)
        self.valid = (self.first != 0) & self.valid[self.source]
        self.rest = self.source[self.rest]
        self.size += 1

    def within(self, starts: np.ndarray) -> np.ndarray:
        """The places in the intervals of this level that start at `starts`."""
        heads = np.flatnonzero(self.heads)
        flags = np.zeros(len(heads), bool)
        flags[np.searchsorted(heads, starts)] = True
        return flags[np.cumsum(self.heads) - 1] if len(heads) else np.zeros(0, bool)

    def intervals(self, among: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """Start, count, occurrences with a word at the left, and at the right, of each phrase of this level; `among`: of places that count."""
        starts = np.flatnonzero(self.heads)
        ends = np.r_[starts[1:], len(self.bwt)]
        keep = self.valid[starts] if among is None else (self.valid & among)[starts]
        starts, ends = starts[keep], ends[keep]
        sums = [np.r_[0, np.cumsum(x != 0)] for x in (self.bwt, self.first[self.rest])]
        return starts, ends - starts, *(s[ends] - s[starts] for s in sums)

    def words(self, starts: np.ndarray) -> list[np.ndarray]:
        """The words of the phrases whose intervals start there, one array for each place in the phrase."""
        out, at = [], starts
        for _ in range(self.size):
            out.append(self.first[at])
            at = self.source[at]
        return out


def packed(x: np.ndarray) -> bytes:
    """Numbers of 32 bits, compressed byte plane by byte plane."""
    return zstandard.compress(np.ascontiguousarray(x.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes(), 3)


def unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1).T).view("<i4").ravel()


_INDEX = pa.schema([("shard", pa.int64()), ("lang", pa.string()), ("n", pa.int64()), ("words", pa.list_(pa.string())), ("bwt", pa.binary())])


def _shards(shard_words: int, depth: int):
    """Indexes of a task's rows (lang, text): one whenever a language has shard_words words, or all have half as many more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[Vocabulary, list[np.ndarray]]] = {}
        sizes: dict[str, int] = {}
        shard = TaskContext.get().partitionId() << 12

        def index(lang: str) -> pa.RecordBatch:
            nonlocal shard
            shard += 1
            vocabulary, parts = held.pop(lang)
            del sizes[lang]
            words = np.concatenate(parts)
            if len(words) >= 1 << PLACE:
                raise ValueError(f"a text of {len(words)} words")
            texts = pa.array([b"", *list(vocabulary)[1:]], pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_pylist([{"shard": shard, "lang": lang, "n": int(np.count_nonzero(words)), "words": texts.to_pylist(), "bwt": packed(transform(words, depth))}], _INDEX)

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if lang not in held:
                    held[lang], sizes[lang] = (Vocabulary(), []), 0
                words = numbered(text.as_py(), held[lang][0])
                held[lang][1].append(words)
                sizes[lang] += len(words)
                if sizes[lang] >= shard_words:
                    yield index(lang)
                elif sum(sizes.values()) >= shard_words * 3 // 2:
                    yield index(max(sizes, key=sizes.__getitem__))
        for lang in sorted(held):
            yield index(lang)

    return run


def build(docs: DataFrame, lang: str = "lang", text: str = "text", depth: int = WORDS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The index table: (shard, lang, n words, vocabulary, transform), written to the shared folder."""
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.make_valid_utf8(whole(text)).cast("binary").alias("text"))
    return written(mapped(rows, _shards(shard_words, depth), "shard long, lang string, n long, words array<string>, bwt binary"), "fm-index")


#: Bits of a place in a shard.
PLACE = 28
#: A row of a phrase and a shard: phrase, tab and language; count; occurrences with a word at the left and right, 32 bits each; shard and interval.
_GRAMS = "key string, n long, sides long, place long"


def _grams(sizes: list[int]):
    """The phrases of some sizes of each shard; where the rows have `nodes` (of the level before the smallest size), those made of two such phrases."""

    def phrases(index: Index, texts: pa.Array, lang: str, shard: int, among: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        found = index.intervals(among)
        for i in range(0, len(found[0]), ROWS):
            starts, *counts = (x[i : i + ROWS] for x in found)
            words = [texts.take(pa.array(w)) for w in index.words(starts)]
            phrase = pc.binary_join_element_wise(*words, " ") if len(words) > 1 else words[0]
            n, left, right = counts
            yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(phrase, lang, "\t"), pa.array(n, pa.int64()), pa.array(left << 32 | right, pa.int64()), pa.array(shard << PLACE | starts, pa.int64())], names=[c.split()[0] for c in _GRAMS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                shard, lang = row.column(0)[0].as_py(), row.column(1)[0].as_py()
                index, texts, among = Index(unpacked(row.column(3)[0].as_py())), row.column(2)[0].values, None
                while index.size < sizes[0] - 1:
                    index.extend()
                if row.num_columns > 4:
                    ok = index.within(row.column(4)[0].values.to_numpy(zero_copy_only=False))
                    among = ok & ok[index.source]
                while index.size < sizes[-1]:
                    if index.size >= sizes[0]:
                        yield from phrases(index, texts, lang, shard, among)
                    index.extend()
                yield from phrases(index, texts, lang, shard, among)

    return run


def _frequent(rows: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, size, shard, node, sums) of phrases whose sums over all shards reach `least`; `one` marks one row of each phrase. A phrase has one row a shard.

    Rows are dealt by phrase and sorted by a hash first, which decides nearly every comparison and needn't be shuffled."""
    rows = rows.repartition("key")
    same = Window.partitionBy(F.xxhash64("key"), "key")
    low = F.lit((1 << 32) - 1)
    total = lambda c: F.sum(c).over(same)
    summed = rows.select("key", "place", total(F.col("n")).alias("a"), total(F.shiftright("sides", 32)).alias("left_n"), total(F.col("sides").bitwiseAND(low)).alias("right_n"), (F.max("place").over(same) == F.col("place")).alias("one")).filter(F.col("a") >= least)
    phrase = F.substring_index("key", "\t", 1)  # which has no tab
    named = summed.select(F.substring(F.col("key"), F.length(phrase) + 2, F.length("key")).alias("lang"), phrase.alias("phrase"), (F.length(phrase) - F.length(F.replace(phrase, F.lit(" "))) + 1).alias("size"), F.shiftright("place", PLACE).alias("shard"), F.col("place").bitwiseAND(F.lit((1 << PLACE) - 1)).cast("int").alias("node"), "a", "left_n", "right_n", "one")
    return written(named.filter(F.col("one") | (F.col("size") > 1)), "grams")


def frequent_phrases(index: DataFrame, least: int = LEAST, words: int = WORDS) -> DataFrame:
    """(lang, phrase, size, a, left_n, right_n) of all phrases of 1 to `words` words that occur `least` times or more in their language."""
    narrow = index.select("shard", "lang", "words", "bwt")
    level = _frequent(mapped(narrow, _grams([1, 2] if words > 1 else [1]), _GRAMS), least)
    levels = [level]
    for size in range(3, words + 1):
        nodes = level.filter(F.col("size") == size - 1).groupBy("shard").agg(F.collect_list("node").alias("nodes"))  # a shard's own intervals
        level = _frequent(mapped(narrow.join(nodes, "shard").select("shard", "lang", "words", "bwt", "nodes"), _grams([size]), _GRAMS), least)
        levels.append(level)
    found = levels[0]
    for level in levels[1:]:
        found = found.union(level)
    return found.filter("one").select("lang", "phrase", "size", "a", "left_n", "right_n")


def scored(frequent: DataFrame, words: int = WORDS) -> DataFrame:
    """Candidates (two words or more) with the parts l and r of their lowest-scoring cut (the first of equals) and its score, without those
    inside a longer candidate that is at least 0.8 as frequent."""
    several = frequent.filter("size >= 2")
    split = several.withColumn("words", F.split("phrase", " "))
    joined = lambda at, n: F.array_join(F.slice("words", at, n), " ")
    cuts = split.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("first"), joined(F.col("k") + 1, F.col("size") - F.col("k")).alias("second"))
    part = lambda name, n: frequent.select("lang", F.col("phrase").alias(name), F.col("a").alias(n))
    sides = cuts.join(part("first", "l"), ["lang", "first"]).join(part("second", "r"), ["lang", "second"])
    score = F.expr("cast(2000000 as decimal(20,0)) * cast(a as decimal(18,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    best = sides.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    places = [(at, n) for n in range(2, words) for at in range(1, words - n + 2)]
    inside = F.filter(F.array(*(F.when(F.col("size") >= at + n - 1, F.when(F.col("size") > n, joined(F.lit(at), F.lit(n)))) for at, n in places)), lambda x: x.isNotNull())
    longer = split.filter("size >= 3").select("lang", F.explode(inside).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    held = several.join(longer, ["lang", "phrase"], "left").filter("longer is null or 100 * cast(longer as decimal(20,0)) < 80 * cast(a as decimal(20,0))")
    return held.join(best, ["lang", "phrase"]).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score", "left_n", "right_n")


def collocations(docs: DataFrame, top: int = TOP, least: int = LEAST, words: int = WORDS, lang: str = "lang", text: str = "text", shard_words: int = SHARD_WORDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score, left_n, right_n: the `top` collocations of each language, by score, a and phrase.

    Whole texts of all rows count, copies too; a null text is empty, a null language "und". a, l, r: occurrences of the phrase and of the two parts
    of its lowest-scoring cut; n: words of the language; left_n, right_n: occurrences with a word of the piece at that side. Equal scores go by a, then by the
    phrase's bytes. Languages without a candidate and empty tables have no rows; other columns are not read. A shard has some shard_words words
    (or one text's, if that has more; one of 2^28 words is an error); a phrase is one row a shard before sums are taken, so no language or phrase is a group of all its occurrences."""
    index = build(docs, lang, text, words, shard_words)
    total = index.groupBy("lang").agg(F.sum("n").alias("n"))
    found = scored(frequent_phrases(index, least, words), words).withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    order = (F.desc("score"), F.desc("a"), F.col("phrase"))
    parts = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "left_n", "right_n")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's 2000 best collocations over all documents."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text"))


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), total AS (
  SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang
), places AS (
  SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM w, range(1, 5) s(size) WHERE len(w) >= size
), f AS (
  SELECT lang, array_to_string(w[i : i + size - 1], ' ') AS phrase, size, count(*) AS a,
         count(*) FILTER (i > 1) AS left_n, count(*) FILTER (i + size - 1 < len(w)) AS right_n
  FROM places GROUP BY ALL HAVING count(*) >= 30
), c AS (
  SELECT *, string_split(phrase, ' ') AS w FROM f WHERE size >= 2
), cuts AS (
  SELECT c.lang, c.phrase, k, x.a AS l, y.a AS r, CAST(CAST(2000000 AS HUGEINT) * c.a // (x.a + y.a) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM c) c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1 : k], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1 :], ' ')
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
  SELECT DISTINCT s.lang, s.phrase FROM c s JOIN (
    SELECT lang, a, array_to_string(w[i : i + n - 1], ' ') AS phrase
    FROM (SELECT *, unnest(range(1, size - n + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS n FROM c))
  ) p ON p.lang = s.lang AND p.phrase = s.phrase AND 100 * CAST(p.a AS HUGEINT) >= 80 * CAST(s.a AS HUGEINT)
), ranked AS (
  SELECT c.lang, row_number() OVER (PARTITION BY c.lang ORDER BY score DESC, a DESC, c.phrase) AS rank, c.phrase, a, l, r, score, left_n, right_n
  FROM c JOIN best USING (lang, phrase) ANTI JOIN inside USING (lang, phrase)
)
SELECT lang, rank, phrase, a, l, r, n, score, left_n, right_n FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""
