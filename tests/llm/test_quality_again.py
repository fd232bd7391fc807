"""The quality query against a second version: features counted character by character, boosting and scores by plain loops."""

import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from compare import DATA

from tidemark.llm import quality, registry

GROUPS = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "!", "?", "|", "*#$%&@^~=+<>", ".", ",;:", "\"'()[]{}", "_/\\-"]
SPACES = " \t\n\r\x0b\x0c"


def plain_features(text):
    text = text or ""
    n = len(text.encode())
    words = [w for w in "".join(" " if c in SPACES else c for c in text).split(" ") if w]
    if not words:
        return [math.log1p(n)] + [0.0] * 22
    seen = Counter(words)
    counts = [sum(text.count(c) for c in g) for g in GROUPS]
    lines = [x for x in text.split("\n") if x]
    sizes = {w: len(w.encode()) for w in seen}
    beyond = sum(len(c.encode()) - 1 for c in text)
    return [
        math.log1p(n), math.log1p(len(words)), (n - len(words)) / len(words), *(c / n for c in counts), beyond / n, len(seen) / len(words), max(seen.values()) / len(words), math.log1p(len(lines)),
        len(words) / max(1, len(lines)), 1 - len(set(lines)) / max(1, len(lines)), counts[0] / max(1, counts[0] + counts[1]), sum(s > 12 for s in sizes.values()) / len(sizes), math.log1p(max(sizes.values())),
    ]


def leaf(g, h):
    return sum(g) / (sum(h) + 1.0)


def tree(g, h, levels=2):
    best, at = 1e-9, None
    for i in range(1, len(g)) if levels else ():
        gl, hl, gr, hr = sum(g[:i]), sum(h[:i]), sum(g[i:]), sum(h[i:])
        if hl >= 1.0 and hr >= 1.0:
            gain = gl * gl / (hl + 1) + gr * gr / (hr + 1) - sum(g) ** 2 / (sum(h) + 1)
            if gain > best + 1e-12:
                best, at = gain, i
    return [leaf(g, h)] * len(g) if at is None else tree(g[:at], h[:at], levels - 1) + tree(g[at:], h[at:], levels - 1)


def quadrants(g, h):
    best = None
    for i in range(7):
        for j in range(7):
            parts = [(rows, columns) for rows in (range(i + 1), range(i + 1, 8)) for columns in (range(j + 1), range(j + 1, 8))]
            sums = [(sum(g[a][b] for a in rows for b in columns), sum(h[a][b] for a in rows for b in columns)) for rows, columns in parts]
            gain = sum(x * x / (w + 1) for x, w in sums) - sum(map(sum, g)) ** 2 / (sum(map(sum, h)) + 1)
            if best is None or gain > best[0] + 1e-9:
                best = gain, i, j, [x / (w + 1) for x, w in sums]
    gain, i, j, leaves = best
    return gain, [[leaves[2 * (a > i) + (b > j)] for b in range(8)] for a in range(8)]


class Plain:
    def __init__(self, x, y, rounds, pair_rounds):
        rate = (sum(y) + 1) / (len(y) + 2)
        self.start = math.log(rate / (1 - rate))
        columns = list(zip(*x, strict=True))
        self.edges = [sorted({float(np.quantile(c, k / 32)) for k in range(1, 32)}) for c in columns]
        self.tables, self.pairs = [[0.0] * (len(e) + 1) for e in self.edges], []
        binned, z = [self.bins(r) for r in x], [self.start] * len(y)

        def slopes():
            p = [1 / (1 + math.exp(-v)) for v in z]
            return [b - a for a, b in zip(p, y, strict=True)], [a * (1 - a) for a in p]

        for _ in range(rounds):
            for f, table in enumerate(self.tables):
                g, h = slopes()
                hg, hh = [0.0] * len(table), [0.0] * len(table)
                for i, b in enumerate(binned):
                    hg[b[f]] += g[i]
                    hh[b[f]] += h[i]
                step = [0.15 * v for v in tree(hg, hh)]
                for k, v in enumerate(step):
                    table[k] += v
                z = [v + step[b[f]] for v, b in zip(z, binned, strict=True)]
        coarse = [[k * 8 // len(t) for k in range(len(t))] for t in self.tables]
        self.coarse = coarse

        def square(a, b, values):
            out = [[0.0] * 8 for _ in range(8)]
            for r, v in zip(binned, values, strict=True):
                out[coarse[a][r[a]]][coarse[b][r[b]]] += v
            return out

        g, h = slopes()
        strength = sorted((-quadrants(square(a, b, g), square(a, b, h))[0], (a, b)) for a in range(len(columns)) for b in range(a + 1, len(columns)))
        self.pairs = [(a, b, [[0.0] * 8 for _ in range(8)]) for _, (a, b) in strength[:8]]
        for _ in range(pair_rounds):
            for a, b, table in self.pairs:
                g, h = slopes()
                step = quadrants(square(a, b, g), square(a, b, h))[1]
                for i in range(8):
                    for j in range(8):
                        table[i][j] += 0.15 * step[i][j]
                z = [v + 0.15 * step[coarse[a][r[a]]][coarse[b][r[b]]] for v, r in zip(z, binned, strict=True)]

    def bins(self, row):
        return [sum(e <= v for e in edges) for v, edges in zip(row, self.edges, strict=True)]

    def score(self, row):
        b = self.bins(row)
        z = self.start + sum(t[k] for t, k in zip(self.tables, b, strict=True)) + sum(t[self.coarse[i][b[i]]][self.coarse[j][b[j]]] for i, j, t in self.pairs)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def test_quality_query_against_plain_loops(spark, monkeypatch):
    monkeypatch.setattr(quality, "ROUNDS", 12)  # of both; loops are slow
    monkeypatch.setattr(quality, "PAIR_ROUNDS", 4)
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet' ORDER BY doc_id").fetchall()
    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{DATA}/labels.parquet'").fetchall())
    rows = {i: plain_features(t) for i, t in docs}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in rows}
    learn = [i for i in sorted(rows) if i in labels and not held[i]]
    assert 50 < len(learn) < quality.FIT_ROWS
    model = Plain([rows[i] for i in learn], [float(labels[i]) for i in learn], 12, 4)
    got = registry.QUERIES["op3_quality"](spark, DATA)
    assert got.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    found = got.collect()
    assert len(found) == len(docs)
    for r in found:
        score = model.score(rows[r["doc_id"]])
        assert r["score"] == pytest.approx(score, abs=1e-9), r["doc_id"]
        assert (r["held_out"], r["predicted"]) == (held[r["doc_id"]], int(score >= 0.3))


def test_held_out_documents_are_told_apart(spark):
    data = "/root/testdata/sf0.01"
    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{data}/labels.parquet'").fetchall())
    rows = [r for r in registry.QUERIES["op3_quality"](spark, data).collect() if r["held_out"] and r["doc_id"] in labels]
    assert len(rows) > 50 and sum(r["predicted"] == labels[r["doc_id"]] for r in rows) >= 0.95 * len(rows)
