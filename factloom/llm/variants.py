"""Spelling variants: words that differ by one letter, found in a trie over letter-group counts.

A word is a path of counts, one for each group of letters in turn; words with the same counts share a leaf. A word
looks for others from the root down: at each level it may take the branch of its own count, once one more (a surplus)
and, after that, once one less (a deficit). What it meets at leaves differs by one letter or is an anagram, so leaf
words are verified. The surplus has to come first, so of two words of a length only one meets the other; a word meets
longer ones by a surplus alone; within one leaf the lesser word looks for the greater.

The upper levels of the trie deal words to tasks: a shard is a node so deep that no node there holds more than SHARD
words, and a word visits each shard that its budget reaches. Where even the deepest node that shards are made of holds
more, its words are dealt to salts, all of which are visited. Within a task the shard's lower levels are tables, and
many words go down at once, depth first in blocks, so that a task holds one shard and one block a level.

A word's form is its near word with the largest count if that is at least twice its own. Forms are followed to the last
one by doubling.

Defined cases: a null text has no words, a null id reads as null; a repeated row counts again; ties between forms go to
the least word in code-point order; words of any length; an empty table gives an empty result; columns other than the
two named are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, slices, stash, table, text_bytes

#: Letters are code points up to U+00FF, so a word is a string of as many bytes.
LETTERS, LEAST = rb"[a-z\xc0-\xff]{%d,}", 5
#: Letter groups by level; letters in none of them are the last group.
GROUPS = ("e", "t", "a", "i", "n", "o", "s", "r", "h", "l", "d", "u", "cm", "gfp", "bwyv")
LEVELS = len(GROUPS) + 1
#: Counts are told apart up to here; beyond, words differ less than their counts do, which costs candidates, not links.
MOST = 31
#: Levels that shards may be made of, five bits each in their key.
UPPER = 12
#: Words of a shard, words that go down a trie at once, candidates that are verified at once.
SHARD, BLOCK, CANDIDATES = 20_000, 16_384, 131_072
#: Letters up to which words are compared side by side; longer ones one by one.
WIDTH = 48
#: Words whose counts a task sums before it passes them on.
HELD = 150_000
_GROUP_OF = np.full(256, LEVELS - 1, np.uint8)
for _i, _letters in enumerate(GROUPS):
    for _c in _letters:
        _GROUP_OF[ord(_c)] = _i


def words(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, times: int = 3, slip: int | None = None) -> DataFrame:
    """(word, n): words of at least so many letters and times. slip: one in so many (by checksum of id and word) loses a letter."""
    own = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("null")).alias("id"), F.col(text).cast("string").alias("text"))
    find = re.compile(LETTERS % least).findall

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def told() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for b in batches:
            for i, j in slices(text_bytes(b.column("text"))[1], 1 << 22):
                for who, x in zip(b.column("id")[i:j].to_pylist(), b.column("text")[i:j].to_pylist(), strict=True):
                    # a character beyond U+00FF becomes a question mark, which ends a run as well
                    found = Counter(find(x.encode("latin-1", "replace").translate(LOWER))) if x else {}
                    before = zlib.crc32(f"{who}:".encode())
                    for w, n in found.items():
                        if slip:
                            h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), before)
                            if not h % slip:
                                k = h % len(w)
                                w = w[:k] + w[k + 1 :]
                                if len(w) < least:
                                    continue
                        held[w] += n
                    if len(held) >= HELD:
                        yield told()
        yield told()

    return own.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= times)


def counts(body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Letters of each group in each word: a row for each word."""
    n = len(offsets) - 1
    row = np.repeat(np.arange(n), np.diff(offsets))
    return np.minimum(np.bincount(row * LEVELS + _GROUP_OF[body], minlength=n * LEVELS).reshape(n, LEVELS), MOST).astype(np.uint8)


def latin(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The words' letters, a byte each, and where each word begins (n + 1)."""
    body, offsets = text_bytes(column)
    if (body < 128).all():
        return body, offsets
    raw = [w.encode("latin-1") for w in column.to_pylist()]
    return np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(w) for w in raw])].astype(np.int64)


def prefixes(vectors: np.ndarray) -> np.ndarray:
    """The first UPPER counts as one number, the first one highest."""
    key = np.zeros(len(vectors), np.int64)
    for k in range(UPPER):
        key = key << 5 | vectors[:, k]
    return key


def probes(vectors: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(rows, key of the upper `depth` levels, budget spent: 0, 1 surplus, 2 both) of all nodes that the budget reaches."""
    key = prefixes(vectors) >> 5 * (UPPER - depth)
    yield np.arange(len(key)), key, 0
    for i in range(depth):
        up = np.flatnonzero(vectors[:, i] < MOST)
        more = key[up] + (1 << 5 * (depth - 1 - i))
        yield up, more, 1
        for j in range(i + 1, depth):
            down = vectors[up, j] > 0
            yield up[down], more[down] - (1 << 5 * (depth - 1 - j)), 2


class Words:
    """Some words side by side."""

    def __init__(self, column: pa.Array) -> None:
        self.body, self.offsets = latin(column)
        self.vectors, self.sizes = counts(self.body, self.offsets), np.diff(self.offsets)
        self.letters = np.zeros((len(self.sizes), WIDTH + 2), np.uint8)
        row = np.repeat(np.arange(len(self.sizes)), self.sizes)
        at = np.arange(len(self.body)) - self.offsets[row]
        near = at < WIDTH + 1
        self.letters[row[near], at[near]] = self.body[near]

    def whole(self, i: int) -> np.ndarray:
        return self.body[self.offsets[i] : self.offsets[i + 1]]


def near(a: Words, i: np.ndarray, b: Words, j: np.ndarray, spent: np.ndarray) -> np.ndarray:
    """Whether b's word is a's with one letter replaced, or one more; with nothing spent, of two of a length the greater."""
    size, longer = a.sizes[i], b.sizes[j] - a.sizes[i]
    ok = (longer == 0) | (longer == 1)
    i, j, spent, size, longer = i[ok], j[ok], spent[ok], size[ok], longer[ok]
    x, y = a.letters[i], b.letters[j]
    differ = x != y
    first = differ.argmax(axis=1)
    shifted = x[:, :-1] != y[:, 1:]
    last = np.where(shifted.any(axis=1), shifted.shape[1] - 1 - shifted[:, ::-1].argmax(axis=1), -1)
    greater = np.take_along_axis(y, first[:, None], 1)[:, 0] > np.take_along_axis(x, first[:, None], 1)[:, 0]
    found = np.where(longer == 0, (differ.sum(axis=1) == 1) & ((spent > 0) | greater), last < first)
    for k in np.flatnonzero(size >= WIDTH):
        x, y = a.whole(i[k]), b.whole(j[k])
        at = np.flatnonzero(x != y[: len(x)])
        f = at[0] if len(at) else len(x)
        found[k] = np.array_equal(x[f:], y[f + 1 :]) if longer[k] else len(at) == 1 and (spent[k] > 0 or y[f] > x[f])
    ok[ok] = found
    return ok


class Trie:
    """The levels of a shard's words from `depth` on: children by node and count; at the end, each leaf's words."""

    def __init__(self, own: Words, depth: int) -> None:
        self.words, self.depth = own, depth
        v = own.vectors[:, depth:]
        self.order = np.lexsort(v.T[::-1]) if v.shape[1] else np.arange(len(v))
        v = v[self.order]
        new = np.zeros(len(v), bool)
        new[:1] = True
        self.children: list[np.ndarray] = []
        nodes = np.zeros(len(v), np.int64)
        for k in range(v.shape[1]):
            new[1:] |= v[1:, k] != v[:-1, k]
            child = np.cumsum(new) - 1
            t = np.full((nodes[-1] + 1, MOST + 3), -1, np.int32)  # with a count of -1 before and MOST + 1 after
            t[nodes[new], v[new, k].astype(np.int64) + 1] = child[new]
            self.children.append(t)
            nodes = child
        self.starts = np.r_[np.flatnonzero(new), len(v)]

    def search(self, asked: Words, spent: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (row asked, row of the trie) that are near."""
        rows = np.arange(len(spent))
        todo = [(0, rows[k : k + BLOCK], np.zeros(len(rows[k : k + BLOCK]), np.int32), spent[k : k + BLOCK]) for k in range(0, len(rows), BLOCK)]
        while todo:
            level, row, node, used = todo.pop()
            if level == len(self.children):
                yield from self._leaves(asked, row, node, used)
                continue
            t, at = self.children[level], asked.vectors[row, self.depth + level].astype(np.int64) + 1
            parts = []
            for step, which, then in ((0, slice(None), None), (1, used == 0, 1), (-1, used == 1, 2)):
                child = t[node[which], at[which] + step]
                there = child >= 0
                parts.append((row[which][there], child[there], used[which][there] if then is None else np.full(there.sum(), then, used.dtype)))
            row, node, used = (np.concatenate(x) for x in zip(*parts, strict=True))
            todo += [(level + 1, row[k : k + BLOCK], node[k : k + BLOCK], used[k : k + BLOCK]) for k in range(0, len(row), BLOCK)]

    def _leaves(self, asked: Words, row: np.ndarray, leaf: np.ndarray, used: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        n = self.starts[leaf + 1] - self.starts[leaf]
        ends = np.cumsum(n)
        for k in range(0, int(ends[-1]) if len(ends) else 0, CANDIDATES):
            place = np.arange(k, min(k + CANDIDATES, ends[-1]))
            of = np.searchsorted(ends, place, "right")
            found = self.order[self.starts[leaf[of]] + place - (ends[of] - n[of])]
            ok = near(asked, row[of], self.words, found, used[of])
            if ok.any():
                yield row[of][ok], found[ok]


#: A word in a shard (spent is -1) or on its way through it.
SENT = "shard long, salt int, spent byte, word string, n long"


def _depth(found: DataFrame, shard: int) -> tuple[int, int]:
    """The least depth at which no node holds more words than a shard may (or UPPER), and the words of its fullest node."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(prefixes(counts(*latin(b.column("word")))))], names=["p"])

    sizes = stash(found.select("word").mapInArrow(keyed, "p long").groupBy("p").agg(F.count("*").alias("n")), "prefixes")
    most = 0
    for depth in range(1, UPPER + 1):
        most = sizes.groupBy(F.shiftright("p", 5 * (UPPER - depth))).agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0
        if most <= shard:
            break
    return depth, most


def near_words(found: DataFrame, shard: int = SHARD) -> DataFrame:
    """(a, b, n_a, n_b): each pair of words that differ by one letter, once. found: (word, n), a word once."""
    found = found.select("word", F.col("n").cast("long").alias("n"))
    depth, most = _depth(found, shard)
    salts = -(-most // shard) or 1

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i, j in slices(text_bytes(whole.column("word"))[1], 1 << 18):
                b = whole.slice(i, j - i)
                body, offsets = latin(b.column("word"))
                vectors = counts(body, offsets)
                mix = [zlib.crc32(w.encode()) % salts for w in b.column("word").to_pylist()] if salts > 1 else np.zeros(len(b), np.int32)
                here = prefixes(vectors) >> 5 * (UPPER - depth)
                yield _sent(b, np.arange(len(b)), here, np.asarray(mix, np.int32), -1)
                for rows, key, spent in probes(vectors, depth):
                    for s in range(salts):
                        yield _sent(b, rows, key, np.full(len(rows), s, np.int32), spent)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, trie, of = None, [], None, None
        for b in batches:
            key = np.stack([b.column(c).to_numpy().astype(np.int64) for c in ("shard", "salt")])
            stored = b.column("spent").to_numpy() < 0
            cut = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(axis=0) | (stored[1:] != stored[:-1]), True]) if len(b) else []
            for i, j in zip(cut, cut[1:], strict=False):
                who, part = (int(key[0, i]), int(key[1, i])), b.slice(i, j - i)
                if who != last:
                    last, held, trie = who, [], None
                if stored[i]:
                    held.append(part)
                    continue
                if not held and trie is None:
                    continue  # nobody lives here
                if trie is None:
                    of = pa.Table.from_batches(held).combine_chunks()
                    trie, held = Trie(Words(of.column("word").combine_chunks()), depth), []
                asked = Words(part.column("word"))
                for x, y in trie.search(asked, part.column("spent").to_numpy()):
                    x, y = pa.array(x), pa.array(y)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("word").take(x), of.column("word").combine_chunks().take(y), part.column("n").take(x), of.column("n").combine_chunks().take(y)], names=["a", "b", "n_a", "n_b"]
                    )

    dealt = found.mapInArrow(sent, SENT).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "spent")
    return dealt.mapInArrow(met, "a string, b string, n_a long, n_b long")


def _sent(b: pa.RecordBatch, rows: np.ndarray, key: np.ndarray, salt: np.ndarray, spent: int) -> pa.RecordBatch:
    at = pa.array(rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(key), pa.array(salt), pa.array(np.full(len(rows), spent, np.int8)), b.column("word").take(at), b.column("n").take(at)], names=["shard", "salt", "spent", "word", "n"]
    )


def last_forms(forms: DataFrame) -> DataFrame:
    """(word, root) of words with forms: where their forms lead, by doubling."""
    found = stash(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        then = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        found = stash(found.join(then, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "forms")
        if found.filter("moved").isEmpty():
            return found.select("word", "root")
        found = found.drop("moved")


def variants(found: DataFrame, shard: int = SHARD) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of words with their counts."""
    found = stash(found.select("word", "n"), "words")
    both = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("m")), F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("m"))))
    seen = near_words(found, shard).select(both.alias("x")).select("x.*")
    best = seen.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    fits = -F.col("best.m") >= 2 * F.col("n")
    judged = found.join(best, "word", "left").select(
        "word", F.when(fits, F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(fits, -F.col("best.m")).alias("form_n")
    )
    judged = stash(judged, "judged")
    roots = last_forms(judged.filter("form IS NOT NULL"))
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants among the words of all documents, one in 97 of which has lost a letter; odd rows as in the module's docstring."""
    return variants(words(table(spark, sf_dir, "documents").select("doc_id", "text"), slip=97))


SQL = {
    "op13_spelling_variants": """
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: xor(c >> 1, CASE WHEN (c & 1) = 1 THEN 3988292384 ELSE 0 END), n)) AS t),
runs AS (SELECT doc_id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{C0}-\\x{FF}]+')) AS w FROM documents) GROUP BY ALL),
hashed AS (SELECT w, n, xor(list_reduce(flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || w, ''),
    lambda x: CASE WHEN ord(x) < 128 THEN [CAST(ord(x) AS BIGINT)] ELSE [195, CAST(ord(x) AS BIGINT) - 64] END)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS h FROM runs, tab WHERE length(w) >= 5),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT n, CASE WHEN h % 97 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (SELECT a.word, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, min({'m': -m, 'w': other}) AS x FROM pairs GROUP BY word),
judged AS (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN -b.x.m >= 2 * w.n THEN b.x.w END AS form, CASE WHEN -b.x.m >= 2 * w.n THEN -b.x.m END AS form_n FROM words w LEFT JOIN best b USING (word)),
steps AS (SELECT word, word AS at FROM judged UNION ALL SELECT s.word, j.form FROM steps s JOIN judged j ON s.at = j.word WHERE j.form IS NOT NULL),
roots AS (SELECT s.word, s.at AS root FROM steps s JOIN judged j ON s.at = j.word WHERE j.form IS NULL)
SELECT word, form, root, n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n FROM judged JOIN roots USING (word)"""
}
