"""Spelling variants by a dictionary of pairs of trie nodes.

The words, and the words reversed, are each sorted over range partitions and read in order,
so the nodes of their two tries get numbers while only the current path is held; a node
that straddles partitions takes the number of the first one that holds it. A word is then, at every
place, an integer pair (node of the part before, node of the part after), once with the
character at that place skipped and once with none skipped. Two words with an equal
skipped pair differ by one replaced character; a skipped pair that equals another word's
unskipped pair is a deletion there, and an insertion the other way round. Numbers stand for whole
prefixes and suffixes, so equal pairs are exact neighbours without a look at the words.

Only nodes shared by several words can be in such a pair, so a path is numbered as far as
a neighbour in the order shares it; the rest of a long word costs nothing. A key's
members differ in one character, so a key has at most as many as the alphabet has characters;
they are counted and ranked inside a window over the key, never paired."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.llm.common import lower_az, stored

LETTERS = "[A-Za-zÀ-ÿ]+"
PART_SHIFT = 40  # a node's number: partition, then place in it


def corpus_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", letters: str = LETTERS,
                 min_chars: int = 7, min_count: int = 2, slip: int | None = None) -> DataFrame:
    """``word``, ``n``: the runs of ``letters`` of the whole texts, A-Z in lower case, with their occurrences; those
    of at least ``min_chars`` code points and ``min_count`` occurrences. With ``slip``, a run loses one character where
    ``slip`` divides the crc32 of ``id:run`` (the place is that number modulo the length): made-up typing errors.

    Null and empty texts have no words; a null id counts as an empty string; repeated rows count again."""
    runs = F.filter(F.regexp_extract_all(lower_az(F.col(text_col).cast("string")), F.lit(letters), F.lit(0)),
                    lambda r: F.length(r) >= min_chars)
    each = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    if slip:
        each = each.withColumn("h", F.crc32(F.concat_ws(":", "id", "run").cast("binary")))
        at = (F.col("h") % F.length("run")).cast("int")
        word = F.when(F.col("h") % slip == 0, F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run"))))
        each = each.select(F.coalesce(word, F.col("run")).alias("word")).where(F.length("word") >= min_chars)
    else:
        each = each.select(F.col("run").alias("word"))
    return each.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _shared(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n  # a[:lo] equal, a[:hi] not
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid)
    return lo


def _number(batches):
    """Words in order to (word, part, nodes, edge): the node numbers of the prefixes of length 1, 2, ...
    as far as a neighbour shares them, and to the end for the first (edge 1) and last (2) word of the partition."""
    import pyarrow as pa
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    size = part << PART_SHIFT
    path: list[int] = []
    word, shared, edge = None, 0, 1
    out = []

    def batch():
        return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([part] * len(out), pa.int32()),
                                           pa.array([o[1] for o in out], pa.list_(pa.int64())), pa.array([o[2] for o in out], pa.int32())],
                                          ["w", "part", "nodes", "edge"])

    for b in batches:
        for nxt in b.column(0).to_pylist():
            common = 0 if word is None else _shared(word, nxt)
            if word is not None:
                out.append((word, path[:] if edge else path[:max(shared, common)], edge))
                edge = 0
                if len(out) >= 4096:
                    yield batch()
                    out.clear()
            path = path[:common] + list(range(size, size + len(nxt) - common))
            size += len(nxt) - common
            word, shared = nxt, common
    if word is not None:
        out.append((word, path, edge | 2))
        yield batch()


def node_numbers(words: DataFrame) -> DataFrame:
    """``w``, ``nodes``: for the distinct strings of column ``w``, the numbers of their trie's nodes along each word, by
    depth from 1. Numbers are equal just where prefixes are. A path ends where no other word shares it (at
    the ends of a range partition it may go on)."""
    rows = stored(words.select("w").repartitionByRange("w").sortWithinPartitions("w")
                  .mapInArrow(_number, "w string, part int, nodes array<bigint>, edge int"), "trie")
    # Two rows per partition: how far a partition's first path was there before, and its numbers there.
    ends: dict[int, dict] = {}
    for r in rows.where("edge > 0").collect():
        for bit in (1, 2):
            if r.edge & bit:
                ends.setdefault(r.part, {})[bit] = (r.w, r.nodes)
    alias, last = [], None
    for part in sorted(ends):
        (first, own), (end, path) = ends[part][1], ends[part][2]
        inherited = last[1][:_shared(last[0], first)] if last else []
        alias.append((part, inherited))
        known = {a: b for a, b in zip(own, inherited)}
        last = (end, [known.get(x, x) for x in path])
    spark = words.sparkSession
    known = spark.createDataFrame([a for a in alias if a[1]], "part int, alias array<bigint>")
    base = F.shiftleft(F.col("part").cast("long"), PART_SHIFT)
    # The first path's own numbers are the partition's first ones, in order of depth.
    mended = F.transform("nodes", lambda x, i: F.when(x == base + i, F.coalesce(F.get("alias", i), x)).otherwise(x))
    return rows.join(known, "part", "left").select("w", F.when(F.col("alias").isNull(), F.col("nodes")).otherwise(mended).alias("nodes"))


def pair_keys(words: DataFrame) -> DataFrame:
    """``word``, ``n``, ``p``, ``s``, ``kind``: the node pairs of every word. Kind 0: a character skipped; 1: skipped, and
    the last of a run of equal ones (so every shorter word arises once); 2: none skipped. -1 is the
    root of either trie; pairs with a node that no other word shares are left out."""
    ahead = node_numbers(words.select(F.col("word").alias("w"))).select(F.col("w").alias("word"), F.col("nodes").alias("before"))
    back = node_numbers(words.select(F.reverse("word").alias("w"))).select(F.reverse("w").alias("word"), F.col("nodes").alias("after"))
    both = words.join(ahead, "word").join(back, "word").withColumn("chars", F.split("word", "")).withColumn("size", F.length("word"))

    def node(nodes: str, depth: Column) -> Column:
        return F.when(depth == 0, F.lit(-1).cast("long")).otherwise(F.get(nodes, depth - 1))

    def pairs(skip: int) -> Column:
        """Places with i characters before, size - i - skip after, both paths that far."""
        lo, hi = F.greatest(F.lit(0), F.col("size") - skip - F.size("after")), F.least(F.size("before"), F.col("size") - skip)
        ends_run = lambda i: ~F.get("chars", i).eqNullSafe(F.when(i + 1 < F.col("size"), F.get("chars", i + 1)))
        kind = (lambda i: ends_run(i).cast("int")) if skip else (lambda i: F.lit(2))
        places = F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.struct(node("before", i).alias("p"), node("after", F.col("size") - i - skip).alias("s"), kind(i).alias("kind")))

    return both.select("word", "n", F.inline(F.concat(pairs(1), pairs(0))))


def near_words(words: DataFrame) -> DataFrame:
    """For the distinct words of ``words`` (columns ``word``, ``n``) that have any: ``word``, ``n_near`` (how many others differ
    by exactly one inserted, deleted or replaced code point), ``form_n`` and ``form`` (the one of them with the
    largest ``n``, of equals the smallest in code-point order)."""
    me = F.struct((-F.col("n")).alias("less"), "word")
    keys = pair_keys(words).select("p", "s", "word", "kind", me.alias("me"))
    key = Window.partitionBy("p", "s")
    order = key.orderBy(F.col("kind") == 2, "me").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    kind = F.col("kind")
    rows = keys.select("word", "kind", "me", F.nth_value("me", 1).over(order).alias("first"), F.nth_value("me", 2).over(order).alias("second"),
                       F.count(F.when(kind < 2, 1)).over(key).alias("skipped"), F.count(F.when(kind == 1, 1)).over(key).alias("longer"),
                       F.min(F.when(kind == 1, F.col("me"))).over(key).alias("best_longer"), F.min(F.when(kind == 2, F.col("me"))).over(key).alias("shorter"))
    replaced = F.when((kind < 2) & (F.col("skipped") > 1), F.when(F.col("me") == F.col("first"), F.col("second")).otherwise(F.col("first")))
    shorter, longer = F.when(kind == 1, F.col("shorter")), F.when(kind == 2, F.col("best_longer"))
    found = rows.select("word", F.least(replaced, shorter, longer).alias("best"),
                        (F.when(replaced.isNotNull(), F.col("skipped") - 1).otherwise(0) + F.when(shorter.isNotNull(), 1).otherwise(0)
                         + F.when(longer.isNotNull(), F.col("longer")).otherwise(0)).alias("c")).where("c > 0")
    return (found.groupBy("word").agg(F.sum("c").cast("long").alias("n_near"), F.min("best").alias("best"))
            .select("word", "n_near", (-F.col("best.less")).alias("form_n"), F.col("best.word").alias("form")))


def variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """One row per word of ``words`` (distinct ``word``, ``n``): ``word``, ``n``, ``n_near``, and ``form``, ``form_n`` (its near word of
    largest ``n`` if that is at least ``ratio`` times its own, else null), ``root`` (forms followed to the last; the
    word itself without one).

    Rows with a null word are left out, a null ``n`` counts as 0 and has no form. An empty table gives an empty result;
    other columns are not read. ``ratio`` must be above 1, so that chains of forms end."""
    if ratio <= 1:
        raise ValueError("ratio must be above 1")
    words = stored(words.where(F.col("word").isNotNull()).select("word", F.coalesce(F.col("n").cast("long"), F.lit(0)).alias("n")), "words")
    near = words.join(near_words(words), "word", "left")
    is_form = (F.col("n") > 0) & (F.col("form_n") >= ratio * F.col("n"))
    rows = stored(near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                              F.when(is_form, F.col("form")).alias("form"), F.when(is_form, F.col("form_n")).alias("form_n")), "near-words")
    links = rows.where("form is not null").select("word", F.col("form").alias("root"))
    while True:  # every round doubles the length of the way followed
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        joined = stored(links.join(ahead, "root", "left"), "forms")
        links = joined.select("word", F.coalesce("further", "root").alias("root"))
        if joined.where("further is not null").isEmpty():
            break
    return rows.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


# The query as DuckDB SQL: CRC-32 by its table (fixed polynomial 0xEDB88320), near words by what is left without one character.
ORACLE = """
WITH RECURSIVE bits AS MATERIALIZED (
  SELECT i AS b, list_reduce(list_prepend(i::BIGINT, [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS t
  FROM range(256) r(i)),
crc AS MATERIALIZED (SELECT list(t ORDER BY b) AS t FROM bits),
run AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[A-Za-z\\x{00C0}-\\x{00FF}]+')) AS run FROM documents),
hashed AS (SELECT run, xor(list_reduce(list_prepend(4294967295::BIGINT, [('0x' || substr(raw, 2 * k + 1, 2))::BIGINT FOR k IN range(length(raw) // 2)]),
        lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h
    FROM (SELECT run, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS raw FROM run WHERE length(run) >= 7), crc),
words AS MATERIALIZED (SELECT word, count(*) AS n FROM (
    SELECT CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM hashed)
    WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
skips AS MATERIALIZED (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM words, unnest(range(1, length(word) + 1)) AS t(i)),
near AS MATERIALIZED (SELECT a.word, b.word AS other, b.n FROM skips a JOIN skips b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
    UNION SELECT s.word, w.word, w.n FROM skips s JOIN words w ON w.word = s.rest
    UNION SELECT w.word, s.word, s.n FROM skips s JOIN words w ON w.word = s.rest),
best AS (SELECT word, count(*) AS n_near, min((-n, other)) AS b FROM near GROUP BY word),
formed AS MATERIALIZED (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN -b.b[1] >= 10 * w.n THEN b.b[2] END AS form,
    CASE WHEN -b.b[1] >= 10 * w.n THEN -b.b[1] END AS form_n FROM words w LEFT JOIN best b ON b.word = w.word),
way(word, root, step) AS (SELECT word, word, 0 FROM formed UNION ALL SELECT way.word, f.form, step + 1 FROM way JOIN formed f ON f.word = way.root WHERE f.form IS NOT NULL),
roots AS (SELECT word, arg_max(root, step) AS root FROM way GROUP BY word)
SELECT f.word, f.form, r.root, f.n::BIGINT AS n, f.n_near::BIGINT AS n_near, f.form_n::BIGINT AS form_n FROM formed f JOIN roots r ON r.word = f.word"""
