"""Line dedup by content-defined chunks of lines.

A rolling hash over the hashes of two neighbouring lines is compared with those of its
neighbours: a chunk ends where it is a minimum. Minima are never side by side, so a
chunk has at least two lines (a text of one line is the exception), and boundaries depend on the lines around
them only, so they come back after an insertion. Inside a run of equal lines, where the hash
stands still, a chunk ends after every second line.

Chunks that occur more than once in the corpus are compared byte for byte. The first
occurrence (by document id, then place) stays, the others are removed; and each
removal goes on over the lines before and after it, up to the ends of the second neighbouring chunks, as long
as they equal those at the first occurrence (equal 64-bit hashes). A removed line so always stands at an
earlier place, too.

DataFrame functions only. Hashes of all chunks are counted first (partial aggregation);
only chunks whose hash repeats carry their text further, and their groups are
aggregates and joins, so no group meets in one task. The hashes that repeat are sent to the texts
up to ``BROADCAST_HASHES`` of them (counted first); beyond, the chunks are joined with them by a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import stored

BROADCAST_HASHES = 2_000_000  # 8 bytes each
BASE, PRIME = 1_000_003, (1 << 31) - 1  # of the rolling hash


def with_chunks(rows: DataFrame, text_col: str) -> DataFrame:
    """``rows`` with ``_lines``, ``_sigs`` (64-bit hash of every line) and ``_cuts`` (number of the last line of each chunk). Null
    text is one empty line."""
    lines = rows.withColumn("_lines", F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "\n"))
    lines = lines.withColumn("_sigs", F.expr("transform(_lines, x -> xxhash64(x))"))
    hashed = lines.withColumn("_h", F.expr("transform(_lines, x -> CAST(conv(substr(md5(x), 1, 8), 16, 10) AS bigint))"))
    rolled = hashed.withColumn("_r", F.expr(f"transform(_h, (h, i) -> (coalesce(get(_h, i - 1), 0L) * {BASE} + h) % {PRIME})"))
    # First lines of the runs of equal lines; a run ends before the next one begins.
    runs = rolled.withColumn("_runs", F.expr("filter(sequence(0, size(_h) - 1), i -> i = 0 OR _h[i] <> _h[i - 1])"))
    pairs = """flatten(transform(_runs, (s, k) -> CASE WHEN coalesce(get(_runs, k + 1), size(_h)) - s >= 2
        THEN sequence(s + 1, coalesce(get(_runs, k + 1), size(_h)) - 1, 2) ELSE CAST(array() AS array<int>) END))"""
    minima = """filter(sequence(0, size(_h) - 1), i -> i >= 1 AND i + 1 < size(_h) AND _r[i] < get(_r, i - 1) AND _r[i] <= get(_r, i + 1)
        AND _h[i] <> get(_h, i - 1) AND _h[i] <> get(_h, i + 1) AND coalesce(get(_h, i - 1) <> get(_h, i - 2), true))"""
    # No cut may leave the last line alone.
    cuts = f"concat(array_sort(filter(concat({pairs}, {minima}), i -> i <= size(_h) - 3)), array(size(_h) - 1))"
    return runs.withColumn("_cuts", F.expr(cuts)).drop("_h", "_r", "_runs")


def _slice(lines: str, past: str, last: str) -> str:
    """SQL: the elements of an array along the lines after the end of chunk ``past`` up to the end of chunk ``last``; chunks
    before the first end at -1, those after the last with the text."""
    end = lambda j: f"CASE WHEN {j} < 0 THEN -1 ELSE coalesce(get(_cuts, {j}), size(_lines) - 1) END"
    return f"CASE WHEN {end(last)} > {end(past)} THEN transform(sequence({end(past)} + 1, {end(last)}), k -> {lines}[k]) ELSE slice({lines}, 1, 0) END"


def chunk_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per chunk of several lines that is not blank: ``id``, ``th`` (hash of the
    whole text), ``j`` (place in the document), ``h``, ``chunk``, and ``before``, ``after`` (hashes of the lines of the
    two neighbouring chunks)."""
    rows = with_chunks(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text")
    each = rows.select("id", F.xxhash64("text").alias("th"), F.expr(f"""
        inline(transform(_cuts, (c, j) -> named_struct('j', j, 'chunk', CASE WHEN c > coalesce(get(_cuts, j - 1), -1) + 1
            THEN array_join({_slice("_lines", "(j - 1)", "j")}, '\\n') END,
            'before', {_slice("_sigs", "(j - 3)", "(j - 1)")}, 'after', {_slice("_sigs", "j", "(j + 2)")})))"""))
    return each.where(F.col("chunk").rlike(r"\S")).select("id", "th", "j", F.xxhash64("chunk").alias("h"), "chunk", "before", "after")


def _common(a: Column, b: Column) -> Column:
    """Number of equal elements at the beginning of two arrays."""
    places = F.sequence(F.lit(0), F.least(F.size(a), F.size(b)) - 1)
    run = F.aggregate(places, F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")),
                      lambda acc, i: F.when(acc["go"] & (F.get(a, i) == F.get(b, i)), F.struct((acc["n"] + 1).alias("n"), F.lit(True).alias("go")))
                      .otherwise(F.struct(acc["n"].alias("n"), F.lit(False).alias("go"))), lambda acc: acc["n"])
    return F.when(F.least(F.size(a), F.size(b)) == 0, 0).otherwise(run)


def repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``th``, ``gone`` of the documents that lose any chunk: sorted structs ``j`` (place of the chunk) and ``l``, ``r``
    (lines lost before and after it). Rows with equal id and text are one document here."""
    chunks = chunk_rows(docs, id_col, text_col)
    many = stored(chunks.groupBy("h").count().where("count > 1").select("h"), "chunk-hashes")
    few = many.count() <= BROADCAST_HASHES
    again = stored(chunks.join(F.broadcast(many) if few else many, "h"), "chunks")
    # Grouping by the chunk itself is the byte comparison.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.struct("id", "th", "j")
    first = (again.groupBy("h", "chunk").agg(F.min(F.struct("id", "th", "j", "before", "after")).alias("first"), F.count("*").alias("n"))
             .where("n > 1").drop("n").repartition(parts))
    gone = (again.join(first, ["h", "chunk"]).where(~place.eqNullSafe(F.struct("first.id", "first.th", "first.j")))
            .select("id", "th", F.struct("j", _common(F.reverse("before"), F.reverse("first.before")).alias("l"),
                                         _common(F.col("after"), F.col("first.after")).alias("r")).alias("g")))
    return gone.groupBy("id", "th").agg(F.sort_array(F.collect_set("g")).alias("gone"))


def remove_repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, ``n_lines``, ``n_removed`` (lines), ``n_chunks_removed``, and ``kept``
    (the other lines, joined; empty if none is left).

    Null and empty texts are one empty line and keep it; a text of one line is no chunk of several and stays. Rows with
    equal id and text are one document: all keep what the document keeps. Null ids come first in the order
    that decides which occurrence stays. Very long texts and long runs of equal lines go by the same rules. An
    empty table gives an empty result; other columns are not read."""
    gone = repeated_chunks(docs, id_col, text_col).select(F.col("id").alias("_id"), F.col("th").alias("_th"), "gone")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("th"))
    both = rows.join(gone, F.col("id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")), "left")
    cut = with_chunks(both.select("id", "text", F.coalesce("gone", F.expr("CAST(array() AS array<struct<j:int,l:int,r:int>>)")).alias("gone")), "text")
    # Chunks and losses in one sorted array: a chunk that is lost has its loss right before it.
    merged = F.expr("""array_sort(concat(transform(gone, g -> named_struct('j', g.j, 'of', 0, 'l', g.l, 'r', g.r)),
        transform(_cuts, (c, j) -> named_struct('j', j, 'of', 1, 'l', 0, 'r', 0))))""")
    cut = cut.withColumn("_all", merged)
    lost = "CASE WHEN get(_all, i - 1).j = x.j THEN get(_all, i - 1) END"
    cut = cut.withColumn("_lost", F.expr(f"filter(transform(_all, (x, i) -> named_struct('of', x.of, 'g', {lost})), x -> x.of = 1)"))
    # What the losses of the two chunks before, and the two after, take of this one.
    start, end = "(coalesce(get(_cuts, j - 1), -1) + 1)", "coalesce(get(_cuts, j + 1), c)"
    lead = f"greatest(coalesce(get(_lost, j - 1).g.r, 0), coalesce(get(_lost, j - 2).g.r, 0) - ({start} - coalesce(get(_cuts, j - 2), -1) - 1), 0)"
    trail = f"greatest(coalesce(get(_lost, j + 1).g.l, 0), coalesce(get(_lost, j + 2).g.l, 0) - ({end} - c), 0)"
    kept = F.expr(f"""flatten(transform(_cuts, (c, j) -> CASE WHEN _lost[j].g IS NOT NULL OR {lead} + {trail} > c - {start} THEN CAST(array() AS array<string>)
        ELSE transform(sequence({start} + {lead}, c - {trail}), k -> _lines[k]) END))""")
    lines = cut.select("id", F.size("_lines").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_chunks_removed"), kept.alias("_kept"))
    return lines.select(F.col("id").alias(id_col), "n_lines", (F.col("n_lines") - F.size("_kept")).alias("n_removed"),
                        "n_chunks_removed", F.array_join("_kept", "\n").alias("kept"))


def _common_sql(a: str, b: str) -> str:
    return f"len([k FOR k IN generate_series(1, least(len({a}), len({b}))) IF {a}[1:k] = {b}[1:k]])"


ORACLE = f"""
WITH line AS (SELECT doc_id, i, lines[i] AS line, ('0x' || substr(md5(lines[i]), 1, 8))::BIGINT AS h, len(lines) AS n
         FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents), unnest(generate_series(1, len(lines))) AS t(i)),
rolled AS (SELECT *, (coalesce(lag(h) OVER w, 0) * {BASE} + h) % {PRIME} AS r, lag(h) OVER w AS h1, lag(h, 2) OVER w AS h2, lead(h) OVER w AS h9
           FROM line WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
run AS (SELECT *, max(CASE WHEN h1 IS NULL OR h <> h1 THEN i END) OVER w AS run_start, lag(r) OVER v AS r1, lead(r) OVER v AS r9
        FROM rolled WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING), v AS (PARTITION BY doc_id ORDER BY i)),
cut AS (SELECT *, CASE WHEN i = n OR i <= n - 2 AND ((i - run_start) % 2 = 1
                   OR r < r1 AND r <= r9 AND h <> h1 AND h <> h9 AND coalesce(h1 <> h2, true)) THEN 1 ELSE 0 END AS ends FROM run),
numbered AS (SELECT *, sum(ends) OVER (PARTITION BY doc_id ORDER BY i) - ends AS j FROM cut),
chunk AS (SELECT doc_id, j, count(*) AS size, list(line ORDER BY i) AS lines FROM numbered GROUP BY doc_id, j),
placed AS (SELECT *, array_to_string(lines, chr(10)) AS body, 
                  list_concat(lag(lines, 2) OVER w, lag(lines) OVER w) AS before, list_concat(lead(lines) OVER w, lead(lines, 2) OVER w) AS after
           FROM chunk WINDOW w AS (PARTITION BY doc_id ORDER BY j)),
ranked AS (SELECT *, size > 1 AND regexp_matches(body, '\\S') AS counts, row_number() OVER v AS place,
                  first_value(before) OVER v AS before0, first_value(after) OVER v AS after0
           FROM placed WINDOW v AS (PARTITION BY body, size > 1 ORDER BY doc_id, j)),
lost AS (SELECT *, counts AND place > 1 AS gone,
                CASE WHEN counts AND place > 1 THEN {_common_sql("list_reverse(before)", "list_reverse(before0)")} ELSE 0 END AS l,
                CASE WHEN counts AND place > 1 THEN {_common_sql("after", "after0")} ELSE 0 END AS r FROM ranked),
rest AS (SELECT *, CASE WHEN gone THEN [] ELSE lines[1 + greatest(coalesce(lag(r) OVER w, 0), coalesce(lag(r, 2) OVER w - lag(size) OVER w, 0), 0)
                : greatest(size - greatest(coalesce(lead(l) OVER w, 0), coalesce(lead(l, 2) OVER w - lead(size) OVER w, 0), 0), 0)] END AS kept
         FROM lost WINDOW w AS (PARTITION BY doc_id ORDER BY j))
SELECT doc_id, CAST(sum(size) AS BIGINT) AS n_lines, CAST(sum(size - len(kept)) AS BIGINT) AS n_removed,
       CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_chunks_removed, sha256(array_to_string(flatten(list(kept ORDER BY j)), chr(10))) AS kept_sha256
FROM rest GROUP BY doc_id"""
