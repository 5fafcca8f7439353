"""Spelling variant grouping: words one edit apart, found by Aho-Corasick automata over halves of words.

If two words differ by one inserted, deleted or replaced code point, the edit lies in one half of either, and the other half
stands whole in the other word: at its start for a left half, at its end for a right half. So the halves of all words are the
patterns of automata, every word is scanned, and a half that occurs at its place in a word of compatible length leads to its
words, whose distance is then verified exactly.

Automata are dealt in shards. A half belongs to the group of its outermost letters (the first three of a left half, the last
three of a right one), and a word is scanned where its own first and last letters lead, so the work grows with the words, not
with words times shards. Where a group has more than ``group_limit`` words, its words are dealt by whole halves and lengths
instead, and where that is too many, by halves of what the halves leave, and so on: no group is cut short, and a task holds
one automaton of a bounded size while words stream through it. Words that share a half are not held against each other one by
one: from a few owners on, their remaining letters are looked up with one letter taken out or left open.

Defined results: null and empty texts have no words; a null id counts as an empty string; repeated rows count each time; ties
go to the word that is smaller in code-point order; empty tables give empty results; further columns, of any name, are ignored.
Words of fewer than ``MIN_CHARS`` code points are not compared: they have no near words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, only, shuffle_partitions, tidy

#: Letters of a word, and code points that a word has at least.
LETTERS, MIN_CHARS = r"[A-Za-zÀ-ÿ]", 7
#: One form is this many times as frequent as its variant.
RATIO = 10
#: Outermost letters that group halves; not more than half of ``MIN_CHARS``.
ANCHOR = 3
#: Words of a group, patterns of a shard, and owners of a half that are compared one by one.
GROUP_LIMIT, SHARD_PATTERNS, FEW = 4_000, 20_000, 6

ENTRY = "shard int, role int, path string, size int, word string, n long"


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", typo_every: int | None = 31, min_count: int = 2) -> DataFrame:
    """``(word, n)``: lower-cased words (A-Z alone) with at least ``MIN_CHARS`` code points and ``min_count`` occurrences.

    With ``typo_every`` a word in a document loses a letter where the crc32 of ``<id>:<word>`` is a multiple of it, at the
    place that this number gives: misspellings whose right forms are known.
    """
    rows = only(docs, id=id_col, text=text_col)
    # A run that is long enough is matched from its first letter on and to its last, so matches are whole runs.
    runs = F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"{LETTERS}{{{MIN_CHARS},}}"), F.lit(0))
    words = rows.select("id", F.explode(runs).alias("w")).select("id", F.translate("w", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("word"))
    if typo_every:
        h = F.crc32(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), "word").cast("binary"))
        at = (F.col("h") % F.length("word")).cast("int")
        cut = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
        words = words.withColumn("h", h).select(F.when(F.col("h") % typo_every == 0, cut).otherwise(F.col("word")).alias("word"))
    return words.where(F.length("word") >= MIN_CHARS).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


@lru_cache(maxsize=1 << 16)
def halves(size: int, path: str) -> tuple[int, int, int, int, tuple[tuple[int, int], ...]]:
    """What a path of left and right halves fixes in a word of ``size``: ``(a, b, s, e, left)``.

    ``a`` letters are fixed at the start and ``b`` at the end once the last half, ``s`` to ``e``, is; ``left`` are the left
    halves that were passed by, where a pair that shares one of them belongs to another path.
    """
    a = b = s = e = 0
    left = []
    for step in path:
        middle = a + (size - a - b) // 2
        if step == "L":
            s, e, a = a, middle, middle
        else:
            left.append((a, middle))
            s, e, b = middle, size - b, size - middle
    return a, b, s, e, tuple(left)


def place(size: int, path: str, length: int) -> tuple[int, int]:
    """Where the path's last half of words of ``size`` stands in a word of ``length``: counted from the start, or from the end."""
    _, _, s, e, _ = halves(size, path)
    shift = 0 if path[-1] == "L" else length - size
    return s + shift, e + shift


def open_forms(text: str) -> Iterator[tuple[int, str]]:
    """The text with each letter left open."""
    return ((i, text[:i] + text[i + 1 :]) for i in range(len(text)))


class Owners:
    """Words of one length that share a half, by the letters between what they share."""

    def __init__(self):
        self.words: list[tuple[str, str, int]] = []
        self.index: dict = {}

    def add(self, middle: str, word: str, n: int) -> None:
        self.words.append((middle, word, n))

    def near(self, middle: str, difference: int) -> Iterator[tuple[str, int]]:
        """Words whose middle is one edit away; they are longer than the scanned word by ``difference``."""
        if len(self.words) <= FEW:
            yield from ((w, n) for m, w, n in self.words if one_edit(m, middle))
            return
        index = self.index.get(difference)
        if index is None:
            index = self.index[difference] = {}
            for m, w, n in self.words:
                for key in open_forms(m) if difference == 0 else {x for _, x in open_forms(m)} if difference == 1 else (m,):
                    index.setdefault(key, []).append((m, w, n))
        keys = open_forms(middle) if difference == 0 else (middle,) if difference == 1 else {x for _, x in open_forms(middle)}
        for key in keys:
            for m, w, n in index.get(key, ()):
                if m != middle:
                    yield w, n


def one_edit(x: str, y: str) -> bool:
    """Whether texts differ by exactly one inserted, deleted or replaced code point."""
    if len(x) < len(y):
        x, y = y, x
    if len(x) - len(y) > 1 or x == y:
        return False
    i = 0
    while i < len(y) and x[i] == y[i]:
        i += 1
    return x[i + 1 :] == y[i + (len(x) == len(y)) :]


class Shard:
    """An automaton over halves and, for each half, the words that it is part of."""

    def __init__(self):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        self.owners: dict[tuple[str, int, str, str], Owners] = {}
        self.ready = False

    def add(self, path: str, word: str, n: int) -> None:
        size = len(word)
        a, b, s, e, _ = halves(size, path)
        kinds = self.automaton.get(word[s:e], None)
        if kinds is None:
            kinds = set()
            self.automaton.add_word(word[s:e], kinds)
        kinds.add((path, size, e - s))
        key = (path, size, word[:a], word[size - b :])
        owners = self.owners.get(key)
        if owners is None:
            owners = self.owners[key] = Owners()
        owners.add(word[a : size - b], word, n)

    def near(self, path: str, size: int, word: str) -> Iterator[tuple[str, int]]:
        """Words one edit from ``word`` that this path finds; ``size`` 0 stands for any compatible length."""
        if not self.ready:
            if len(self.automaton):
                self.automaton.make_automaton()
            self.ready = True
        if not len(self.automaton):
            return
        length = len(word)
        for end, kinds in self.automaton.iter(word):
            for kind, own, span in kinds:
                if kind != path or abs(own - length) > 1 or (size and own != size) or (end + 1 - span, end + 1) != place(own, kind, length):
                    continue
                a, b, _, _, left = halves(own, kind)
                owners = self.owners.get((kind, own, word[:a], word[length - b :]))
                for w, n in owners.near(word[a : length - b], own - length) if owners else ():
                    if all(w[s:e] != word[s:e] for s, e in left):
                        yield w, n


@tidy
def scan(batches):
    """Near words of the entries of a task's shards, each shard's patterns before the words that are scanned: for a scanned
    word with any, their number and the most frequent one."""
    import pyarrow as pa

    at, shard = None, None
    for batch in batches:
        out = []
        for number, role, path, size, word, n in zip(*(c.to_pylist() for c in batch.columns)):
            if number != at:
                at, shard = number, Shard()
            if role == 0:
                shard.add(path, word, n)
                continue
            found = list(shard.near(path, size, word))
            if found:
                best = min(found, key=lambda f: (-f[1], f[0]))
                out.append((word, n, len(found), best[1], best[0]))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["word", "n", "n_near", "near_n", "near"]
        )


def _deeper(rows: DataFrame) -> DataFrame:
    """Entries ``(role, path, size, word, n, grp, open)`` one path step down from ``(role, path, size, word, n)``.

    Groups are all that a path fixes: its letters and the length; ``open`` letters are left between them. At the first level (one letter of path, size 0) patterns take
    their own length and words each compatible one.
    """

    @tidy
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for role, path, size, word, n in zip(*(c.to_pylist() for c in batch.columns)):
                length = len(word)
                first = not size
                for own in (length,) if role == 0 else (length - 1, length, length + 1) if first else (size,):
                    for step in (path,) if first else (path + "L", path + "R"):
                        a, b, _, _, _ = halves(own, step)
                        if a + b <= length:
                            out.append((role, step, own, word, n, f"{step} {own} {word[:a]} {word[length - b :]}", own - a - b))
            kinds = (pa.int32(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], ["role", "path", "size", "word", "n", "grp", "open"])

    return rows.select("role", "path", "size", "word", "n").mapInArrow(run, "role int, path string, size int, word string, n long, grp string, open int")


def near_words(words: DataFrame, scratch: Scratch, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """``(word, n_near, near, near_n)`` of every word of ``(word, n)`` that has near words: their number and the most frequent.

    ``words`` is a written table with each word once.
    """
    roles = F.explode(F.array(*(F.struct(F.lit(r).alias("role"), F.lit(p).alias("path"), g.alias("grp")) for p, g in (
        ("L", F.substring("word", 1, ANCHOR)), ("R", F.substring("word", -ANCHOR, ANCHOR))) for r in (0, 1))))
    long_enough = words.where(F.length("word") >= MIN_CHARS)
    now = long_enough.select("word", "n", roles.alias("e")).select("e.role", "e.path", F.lit(0).alias("size"), "word", "n", F.concat("e.path", F.lit(" "), "e.grp").alias("grp"), F.lit(MIN_CHARS).alias("open"))
    kept = []
    while True:
        counted = now.groupBy("grp").agg(F.count_if(F.col("role") == 0).alias("own"), F.count_if(F.col("role") == 1).alias("scanned"), F.min("open").alias("open"))
        # A single open letter has no halves; such a group holds no more words than the alphabet has letters.
        big = scratch.write(counted.where((F.greatest("own", "scanned") > group_limit) & (F.col("own") > 0) & (F.col("open") > 1)).select("grp"))
        if big.isEmpty():
            kept.append(now)
            break
        kept.append(now.join(big, "grp", "left_anti"))
        now = scratch.write(_deeper(now.join(big, "grp", "left_semi")))
    entries = kept[0]
    for more in kept[1:]:
        entries = entries.unionByName(more)
    tasks = shuffle_partitions(words.sparkSession)
    shards = max(tasks, -(-2 * words.count() // SHARD_PATTERNS))
    dealt = entries.select(F.expr(f"CAST(pmod(xxhash64(grp), {shards}) AS INT)").alias("shard"), "role", "path", "size", "word", "n")
    found = dealt.repartition(tasks, "shard").sortWithinPartitions("shard", "role").mapInArrow(scan, "word string, n long, n_near long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """``(word, root)`` of ``(word, form)``: where following forms ends. Each round doubles the steps taken, and as a form is
    ``RATIO`` times as frequent as its word, chains have fewer than twenty links."""
    now = scratch.write(forms.select("word", F.col("form").alias("root")))
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        then = scratch.write(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        scratch.drop(now)
        now = then
        if now.where("moved").isEmpty():
            return now.select("word", "root")


def variant_groups(words: DataFrame, ratio: int = RATIO, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """``(word, n, n_near, form, form_n, root)`` of ``(word, n)``: a word's form is its most frequent near word, if that is
    ``ratio`` times as frequent; its root is where forms lead."""
    scratch = Scratch(words.sparkSession, "spelling")
    words = scratch.write(words.select("word", "n"))
    near = near_words(words, scratch, group_limit)
    is_form = F.col("near_n") >= ratio * F.col("n")
    joined = scratch.write(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n")
        )
    )
    ends = roots(joined.where("form IS NOT NULL"), scratch)
    return joined.join(ends, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


SQL = f"""
WITH RECURSIVE tab AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i))
), said AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, translate(unnest(regexp_extract_all(text, '{LETTERS}{{{MIN_CHARS},}}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents
), own AS (SELECT d, w, count(*) AS n, hex(encode(d || ':' || w)) AS x FROM said GROUP BY d, w),
byte AS (SELECT d, w, n, list_transform(range(length(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT)) AS b FROM own),
crc AS (SELECT d, w, n, xor(list_reduce(list_concat([4294967295], b), lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295) AS h FROM byte, tab),
typed AS (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, CAST(h % length(w) AS BIGINT)) || substr(w, CAST(h % length(w) AS BIGINT) + 2) ELSE w END AS word, n FROM crc),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM typed WHERE length(word) >= {MIN_CHARS} GROUP BY word HAVING sum(n) >= 2),
k AS (SELECT word, n, substr(word, 1, i) || '*' || substr(word, i + 2) AS s, substr(word, 1, i) || substr(word, i + 2) AS d FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)),
near AS (
  SELECT a.word AS x, b.word AS y, b.n FROM k a JOIN k b ON a.s = b.s AND a.word <> b.word
  UNION SELECT k.word, w.word, w.n FROM k JOIN w ON w.word = k.d UNION SELECT w.word, k.word, k.n FROM k JOIN w ON w.word = k.d
), best AS (SELECT x, count(*) AS n_near, max(n) AS top, first(y ORDER BY n DESC, y) AS y FROM near GROUP BY x),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= {RATIO} * w.n THEN y END AS form, CASE WHEN top >= {RATIO} * w.n THEN top END AS form_n FROM w LEFT JOIN best ON x = w.word),
r AS (SELECT word, word AS root, 0 AS step FROM f UNION ALL SELECT r.word, f.form, step + 1 FROM r JOIN f ON f.word = r.root WHERE f.form IS NOT NULL),
e AS (SELECT word, arg_max(root, step) AS root FROM r GROUP BY word)
SELECT f.word, f.form, e.root, f.n, f.n_near, f.form_n FROM f JOIN e ON e.word = f.word"""
