"""Spelling variants: words one edit apart, found in a trie of letter-group counts.

Letters are dealt to groups of about equal frequency. A word's path in the trie
is its length, then its count of each group's letters. One inserted letter adds
one to one count, a deleted one takes one, a replaced one does both or changes
no count; so a search for a word's neighbours goes down the trie with a budget
of one surplus and one deficit, and compares the words of the leaves it reaches
letter by letter.

The upper trie is a table of nodes, split until a cell holds few enough words;
words find the cells within their budget by joins on paths, one a level. The
lower trie of a cell is searched depth first in one task, all words that arrive
at a node at once. Cells that many words reach are searched by several tasks.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docverify.plans.storage import written

#: Code points and occurrences that a word must have.
LEAST_LENGTH = 7
LEAST_COUNT = 2
#: One run in so many loses a letter (h % DROP == 0).
DROP = 31
#: A form occurs at least so many times as often as its variant.
RATIO = 10
#: Letter groups, which are levels of the trie below the length.
GROUPS = 16
#: Words of a cell, and words that search it, in one task.
CELL = 1 << 16
QUERIES = 1 << 17
#: Words of a node whose counts are compared at once.
LEAF = 128
#: Pairs of words, times their letters, that are compared at once.
PAIR_BYTES = 1 << 23
#: Different words that a task counts before it passes them on.
HELD = 300_000
#: Characters that are split into runs at a time.
PIECE = 1 << 20

LETTERS = "A-Za-zÀ-ÿ"
_RUN = re.compile(f"[{LETTERS}]{{{LEAST_LENGTH},}}")
_NO_LETTER = re.compile(f"[^{LETTERS}]")
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def _pieces(text: str):
    """The text in pieces that end between runs, A-Z lower-cased."""
    at = 0
    while at < len(text):
        end = len(text)
        if end - at > PIECE and (cut := _NO_LETTER.search(text, at + PIECE)):
            end = cut.start()
        yield text[at:end].encode("utf-8", "surrogatepass").translate(_LOWER).decode("utf-8", "surrogatepass")
        at = end


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of words of LEAST_LENGTH code points or more that occur `least` times over all documents.

    Runs of LETTERS, A-Z lower-cased; with h the CRC-32 of "<id>:<run>", a run
    whose h is a multiple of DROP loses its letter at h % length. A null text
    has no runs, a null id is an empty string.
    """

    def counted(batches):
        counts: dict[str, int] = {}

        def batch_of() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                head = zlib.crc32(f"{doc_id or ''}:".encode())
                for piece in _pieces(text.as_py() or ""):
                    own: dict[str, int] = {}
                    for run in _RUN.findall(piece):
                        own[run] = own.get(run, 0) + 1
                    for run, n in own.items():
                        h = zlib.crc32(run.encode(), head)
                        if h % DROP == 0:
                            at = h % len(run)
                            run = run[:at] + run[at + 1 :]
                            if len(run) < LEAST_LENGTH:
                                continue
                        counts[run] = counts.get(run, 0) + n
                    if len(counts) >= HELD:
                        yield batch_of()
        yield batch_of()

    source = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def letter_groups(words: DataFrame, groups: int = GROUPS) -> list[str]:
    """Letters dealt to groups of about equal frequency, commonest first; at most 116 letters."""

    def totals(batches):
        seen = np.zeros(256, np.int64)
        for batch in batches:
            text = "".join(batch.column(0).to_pylist()).encode("latin-1")
            seen += np.bincount(np.frombuffer(text, np.uint8), minlength=256)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(seen[at])], names=["letter", "n"])

    found = words.select("word").mapInArrow(totals, "letter long, n long").groupBy("letter").agg(F.sum("n").alias("n")).collect()
    out, sums = [""] * groups, [0] * groups
    for letter, n in sorted(found, key=lambda r: (-r.n, r.letter)):
        least = sums.index(min(sums))
        out[least] += chr(letter)
        sums[least] += n
    return [x for x in out if x]


def _count_of(letters: str) -> Column:
    return F.char_length("word") - F.char_length(F.translate("word", letters, ""))


def _cells(words: DataFrame, groups: list[str], cell: int) -> tuple[DataFrame, DataFrame, int]:
    """words with their cell's path, and the trie's upper nodes: (path, split), and the number of levels below the length."""
    open_, closed, nodes = words.withColumn("path", F.char_length("word").cast("string")), None, None
    for level in range(len(groups) + 1):
        sizes = open_.groupBy("path").agg(F.count(F.lit(1)).alias("size"))
        if level == len(groups):
            sizes = sizes.withColumn("size", F.lit(0).cast("long"))  # no level left: a leaf of any size
        own = written(sizes.select("path", (F.col("size") > cell).alias("split")), "spelling-nodes")
        nodes = own if nodes is None else nodes.union(own)
        marked = open_.join(own, "path")
        done = marked.where("not split").drop("split")
        closed = done if closed is None else closed.unionByName(done)
        if not own.where("split").take(1):
            return written(closed, "spelling-cells"), written(nodes, "spelling-trie"), level
        count = _count_of(groups[level]).cast("string")
        open_ = written(marked.where("split").withColumn("path", F.concat_ws(".", "path", count)).drop("split"), "spelling-open")
    raise AssertionError("the last level has no splits")


def _routed(words: DataFrame, nodes: DataFrame, groups: list[str], levels: int) -> DataFrame:
    """(word, path): the cells that a word's neighbours can be in."""
    length = F.char_length("word")
    starts = [
        F.struct((length + by).cast("string").alias("path"), F.lit(surplus).alias("surplus"), F.lit(deficit).alias("deficit"))
        for by, surplus, deficit in ((-1, 0, 1), (0, 1, 1), (1, 1, 0))
    ]
    at, found = words.select("word", F.explode(F.array(*starts)).alias("to")).select("word", "to.*"), None
    for level in range(levels + 1):
        there = at.join(nodes, "path")
        cells = there.where("not split").select("word", "path")
        found = cells if found is None else found.union(cells)
        if level == levels:
            break
        count = _count_of(groups[level])

        def child(by: int, surplus: Column, deficit: Column, count: Column = count) -> Column:
            return F.struct(F.concat_ws(".", "path", (count + by).cast("string")).alias("path"), surplus.alias("surplus"), deficit.alias("deficit"))

        s, d = F.col("surplus"), F.col("deficit")
        steps = F.array(child(0, s, d), F.when(s > 0, child(1, s - 1, d)), F.when(d > 0, child(-1, s, d - 1)))
        at = there.where("split").select("word", F.explode(F.array_compact(steps)).alias("to")).select("word", "to.*")
    return found


class _Trie:
    """Words of one length, in the order of their paths."""

    def __init__(self, words: list[str], counts: list[int], group_of: np.ndarray, groups: int):
        best = sorted(range(len(words)), key=lambda i: (-counts[i], words[i]))
        self.letters = letters_of(words)
        self.vectors = vectors_of(self.letters, group_of, groups)
        order = np.lexsort(self.vectors.T[::-1])
        rank = np.empty(len(words), np.int64)
        rank[best] = np.arange(len(words))
        self.letters, self.vectors, self.rank, self.best = self.letters[order], self.vectors[order], rank[order], best

    def search(self, letters: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For words of one length: how many neighbours each has here, and the best one's rank."""
        self.q_letters, self.q_vectors = letters, vectors
        self.n_near, self.first = np.zeros(len(letters), np.int64), np.full(len(letters), len(self.rank), np.int64)
        longer = self.letters.shape[1] - letters.shape[1]
        whole = np.arange(len(letters))
        spent = np.zeros(len(letters), np.int8)
        self._visit(0, len(self.rank), 0, whole, spent + (longer >= 0), spent + (longer <= 0))
        return self.n_near, self.first

    def _visit(self, low: int, high: int, level: int, q: np.ndarray, surplus: np.ndarray, deficit: np.ndarray) -> None:
        if high - low <= LEAF or level == self.vectors.shape[1]:
            self._leaf(low, high, level, q, surplus + deficit)
            return
        column, own = self.vectors[low:high, level], self.q_vectors[q, level]
        cuts = [0, *(np.flatnonzero(np.diff(column)) + 1).tolist(), high - low]
        for a, b in zip(cuts, cuts[1:], strict=False):
            by = column[a] - own
            keep = np.flatnonzero((by == 0) | ((by == 1) & (surplus > 0)) | ((by == -1) & (deficit > 0)))
            if len(keep):
                by = by[keep]
                self._visit(low + a, low + b, level + 1, q[keep], surplus[keep] - (by == 1), deficit[keep] - (by == -1))

    def _leaf(self, low: int, high: int, level: int, q: np.ndarray, budget: np.ndarray) -> None:
        """Pairs whose other counts differ within the budget: by as many as it has left, or by none.

        What is left of the surplus less the deficit is the difference of the
        sums; so the squares of the differences add up to the budget at most
        just where no count differs by more than one and none is overspent.
        """
        step = max(1, PAIR_BYTES // (8 * (high - low)))
        here = self.vectors[low:high, level:]
        norms = (here * here).sum(1)
        for i in range(0, len(q), step):
            part = self.q_vectors[q[i : i + step], level:]
            apart = (part * part).sum(1)[:, None] + norms - 2 * (part @ here.T)
            one, other = np.nonzero(apart <= budget[i : i + step, None])
            self._compare(q[i + one], low + other)

    def _compare(self, q: np.ndarray, x: np.ndarray) -> None:
        width = self.letters.shape[1]
        step = max(1, PAIR_BYTES // (4 * width + 1))
        for i in range(0, len(q), step):
            a, b = q[i : i + step], x[i : i + step]
            near = one_edit(self.q_letters[a], self.letters[b])
            a, b = a[near], b[near]
            np.add.at(self.n_near, a, 1)
            np.minimum.at(self.first, a, self.rank[b])


def letters_of(words: list[str]) -> np.ndarray:
    """Words of one length as rows of letters."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)


def vectors_of(letters: np.ndarray, group_of: np.ndarray, groups: int) -> np.ndarray:
    """Counts of each group's letters; exact as floats up to 2^53, or for short words 2^24."""
    of = group_of[letters]
    return np.stack([(of == g).sum(1) for g in range(groups)], 1).astype(np.float32 if letters.shape[1] < 2000 else np.float64)


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether each pair of rows differs by exactly one replaced, or one inserted letter."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(1) == 1
    short, long = (a, b) if a.shape[1] < b.shape[1] else (b, a)
    same = np.logical_and.accumulate(short == long[:, :-1], 1).sum(1)
    after = np.logical_and.accumulate((short == long[:, 1:])[:, ::-1], 1).sum(1)
    return same + after >= short.shape[1]


def near_words(words: DataFrame, groups: int = GROUPS, cell: int = CELL, queries: int = QUERIES) -> DataFrame:
    """(word, n_near, form_n, near): of each word (word, n) with words one edit apart in the table, how many they
    are, and the one of largest n, on a tie the first in code-point order. Words are distinct, of LETTERS.
    """
    letters = letter_groups(words, groups)
    levels = len(letters)
    group_of = np.zeros(256, np.uint8)
    for g, own in enumerate(letters):
        group_of[[ord(x) for x in own]] = g
    index, nodes, depth = _cells(words, letters, cell)
    routed = written(_routed(words, nodes, letters, depth), "spelling-routed")
    # a cell is searched by as many tasks as its queries need; one that no level splits is dealt in blocks
    sizes = index.groupBy("path").agg(F.ceil(F.count(F.lit(1)) / cell).alias("blocks"))
    splits = routed.groupBy("path").agg(F.ceil(F.count(F.lit(1)) / queries).alias("salts")).join(sizes, "path")
    splits = written(splits, "spelling-splits")
    key, spread = F.xxhash64("word"), lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    held = index.join(splits, "path").select("path", F.pmod(key, "blocks").alias("block"), spread("salts").alias("salt"), "word", "n")
    asked = routed.join(splits, "path").select("path", spread("blocks").alias("block"), F.pmod(key, "salts").alias("salt"), "word", F.lit(None).cast("long").alias("n"))
    schema = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("form_n", pa.int64()), ("near", pa.string())])

    def search(cell_rows: pa.Table) -> pa.Table:
        rows = cell_rows.filter(pa.compute.is_valid(cell_rows.column("n")))
        words, counts = rows.column("word").to_pylist(), rows.column("n").to_pylist()
        if not words:
            return schema.empty_table()
        trie, asking = _Trie(words, counts, group_of, levels), {}
        for word in cell_rows.filter(pa.compute.is_null(cell_rows.column("n"))).column("word").to_pylist():
            asking.setdefault(len(word), []).append(word)
        out = []
        for some in asking.values():
            letters = letters_of(some)
            n_near, first = trie.search(letters, vectors_of(letters, group_of, levels))
            hit = np.flatnonzero(n_near)
            best = [trie.best[i] for i in first[hit].tolist()]
            columns = [some[i] for i in hit.tolist()], n_near[hit], [counts[i] for i in best], [words[i] for i in best]
            out.append(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    found = held.union(asked).groupBy("path", "block", "salt").applyInArrow(search, "word string, n_near long, form_n long, near string")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "near"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select(
        "word", "n_near", (-F.col("b.less")).alias("form_n"), F.col("b.near").alias("near")
    )


def _roots(links: DataFrame) -> DataFrame:
    """(word, root) of (word, form): forms followed to the last. Their counts grow, so there is one, some steps away."""
    at = written(links.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = written(at.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        at = moved.select("word", "root")
        if not moved.where("moved").take(1):
            return at


def spelling_variants(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratio: int = RATIO, groups: int = GROUPS, cell: int = CELL, queries: int = QUERIES
) -> DataFrame:
    """One row a word: word, form, root, n, n_near, form_n.

    Words and their n are those of word_counts. Near words differ by exactly
    one inserted, deleted or replaced letter; n_near counts them. The form is
    the near word of largest n (on a tie the first in code-point order) if that
    n is at least ratio times the word's; else it and form_n are null. The root
    is the last of the word's forms' forms, the word itself if it has none.
    Other columns are ignored; an empty table gives no rows.
    """
    words = written(word_counts(docs, id_col, text_col), "spelling-words")
    near = words.join(near_words(words, groups, cell, queries), "word", "left")
    is_form = F.col("form_n") >= ratio * F.col("n")
    found = written(
        near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("form_n")).alias("form_n")),
        "spelling-forms",
    )
    roots = _roots(found.where("form is not null").select("word", "form"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


ORACLE = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
run AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY ALL),
hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(CAST(length(x) / 2 AS BIGINT)),
    lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h
  FROM (SELECT run, n, hex(encode(concat(doc_id, ':', run))) AS x FROM run), crc),
word AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT n, CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
gap AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM word)),
pair AS (
  SELECT a.word, a.n, b.word AS near, b.n AS m FROM gap a JOIN gap b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT g.word, g.n, w.word, w.n FROM gap g JOIN word w ON g.rest = w.word
  UNION SELECT w.word, w.n, g.word, g.n FROM gap g JOIN word w ON g.rest = w.word),
best AS (
  SELECT word, count(*) AS n_near, max(m) AS m, arg_min(near, (-m, near)) AS near FROM pair GROUP BY word),
formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * n THEN near END AS form, CASE WHEN m >= 10 * n THEN m END AS form_n
  FROM word w LEFT JOIN best USING (word)),
step AS (
  SELECT word, word AS last, 0 AS k FROM formed
  UNION ALL SELECT step.word, formed.form, k + 1 FROM step JOIN formed ON formed.word = step.last WHERE formed.form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN (SELECT word, arg_max(last, k) AS root FROM step GROUP BY word) USING (word)
"""
