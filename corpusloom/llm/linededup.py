"""Line dedup by a segment-partition edit join, in DataFrame and SQL functions alone.

Two lines within edit distance t share, untouched, at least one of the t + 1 segments of
the shorter one (pigeonhole).  Every distinct line puts the hashes of its own segments in
an index, by segment number and line length, and probes the indexes of its own length and
of up to t less with the substrings that can still be that segment: those whose shift is
within the edits that are possible left and right of it.

Lines may differ in one edit for every ``CHARS_PER_EDIT`` code points of the shorter one,
and in t at most; shorter lines are compared for equality alone.

A line is removed if an identical line, or a near one, stands earlier: in a document with
a smaller id, or above it in its own.  All lines are those of the input.  So one earlier
near line is enough to settle a line, and the pairs of a large group need not be made:

1. An index key is an aggregate: its leader, the line that stands first, and whether it
   has other owners.  Each probe meets the leader alone, so this join is linear.
2. Lines that meet a leader are verified against it.  The later line of a near pair is
   settled.
3. Keys with several owners are joined with their probes, but only for pairs whose later
   line is not settled yet.  Each line carries a signature, the parities of its hashed
   pairs of neighbouring characters in 512 bits: an edit flips four of them at most, so
   the join makes no row for lines that are far apart.  What passes is verified.

Verification cuts common ends off, and a banded bit-parallel recurrence (a
vertical-difference word of 2 t + 1 diagonals moved along the band) decides; before it
come conditions that near lines must fulfil, lengths and signatures.

Copies are counted by line hash before anything else, and a line that very many documents
hold is one row from then on.  A line is known by a 64-bit hash; should two different
lines share one (a second hash tells), both stay as they are.

Side tables of at most ``SMALL`` rows, which is counted, are broadcast; larger ones meet
the lines in a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.shared import Tables, unused, written
from corpusloom.llm.sqltext import let

CHARS_PER_EDIT = 12
#: Words of 64 bits of the signature; bits of it that one edit flips at most.
WORDS, FLIPS = 8, 4
#: Rows of a table that is broadcast.
SMALL = 500_000


def small(table: DataFrame) -> DataFrame:
    """A stored table, marked to be broadcast if it has at most SMALL rows."""
    return F.broadcast(table) if table.count() <= SMALL else table


def lines_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, row, pos, line, h): row is a hash of the text, which tells apart rows that repeat an id.

    Blank lines are left out.  A null text gives no line.
    """
    lines = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("row"), F.posexplode(F.split(text_col, "\n")).alias("pos", "line"))
    return lines.where(r"trim(BOTH ' \t\r' FROM line) <> ''").withColumn("h", F.xxhash64("line"))


def repeated_lines(lines: DataFrame, tables: Tables) -> DataFrame:
    """(h, first, single): lines that occur more than once, with the struct of their first (id, row, pos); single: no other line has the hash."""
    counted = lines.groupBy("h").agg(F.count("*").alias("copies"))
    often = small(tables.written(counted.where("copies > 1").select("h"), "repeated-lines"))
    placed = lines.select("h", F.struct("id", "row", "pos").alias("at"), F.xxhash64(F.lit("line"), "line").alias("g")).join(often, "h")
    found = placed.groupBy("h").agg(F.min("at").alias("first"), (F.min("g") == F.max("g")).alias("single"))
    return tables.written(found, "first-places")


def distinct_lines(lines: DataFrame, repeated: DataFrame) -> DataFrame:
    """(h, line, n, first): each line once, where it stands first; lines that share a hash are left out."""
    at = F.struct("id", "row", "pos")
    known = lines.join(small(repeated), "h", "left").where(F.col("first").isNull() | F.col("single") & (F.col("first") == at))
    return known.select("h", "line", F.length("line").alias("n"), at.alias("first"))


def _keyed(distinct: DataFrame, places: list[tuple[int, int, int]], threshold: int, more: list[Column]) -> DataFrame:
    """(key, h, more) for each line and place, a place being (how much shorter, segment, shift).

    Places are rows before they are keys: generated code stays small enough to be compiled.
    """
    parts = threshold + 1
    rows = ", ".join(f"named_struct('less', {a}, 'i', {i}, 'shift', {s}, 'own', {'true' if a == s == 0 else 'false'})" for a, i, s in places)
    least = max(CHARS_PER_EDIT, 2 * threshold + 2)
    each = distinct.where(F.col("n") >= least).select("h", "first", "line", "n", F.expr(f"inline(array({rows}))")).where(F.col("n") - F.col("less") >= least)
    n = F.col("n") - F.col("less")
    start = F.expr(f"CAST((n - less) * i DIV {parts} AS INT)")
    size = F.expr(f"CAST((n - less) * (i + 1) DIV {parts} AS INT)") - start
    return each.select(F.xxhash64(F.substring("line", start + F.col("shift") + 1, size), n, "i").alias("key"), "h", *more)


def index_places(threshold: int) -> list[tuple[int, int, int]]:
    return [(0, i, 0) for i in range(threshold + 1)]


def probe_places(threshold: int) -> list[tuple[int, int, int]]:
    """All substrings that can be a segment of a line as long or up to threshold shorter.

    A segment can shift by the edits that are possible left of it, and by those right of
    it against the difference in length.
    """
    t = threshold
    return [(less, i, shift) for less in range(t + 1) for i in range(t + 1) for shift in range(max(-i, less - (t - i)), min(i, less + t - i) + 1)]


def _common_prefix(a: str, b: str) -> str:
    """Code points that a and b begin with alike, found by halving steps; SQL text."""
    most = f"least(length({a}), length({b}))"
    steps = "transform(sequence(0, 31), k -> shiftleft(1L, 31 - k))"
    return f"aggregate({steps}, 0L, (at, s) -> IF(at + s <= {most} AND substring({a}, CAST(at + 1 AS INT), CAST(s AS INT)) = substring({b}, CAST(at + 1 AS INT), CAST(s AS INT)), at + s, at))"


def banded_distance(a: str, b: str, threshold: int) -> str:
    """SQL text: whether the edit distance of strings a and b is at most the threshold.

    a: not longer than b.  The top bit of the words is the lowest diagonal of the band,
    which moves down one row with each code point of b.  The score follows that diagonal
    while there are rows, then the last row.  Once it cannot come back, steps do nothing.
    """
    t, width = threshold, 2 * threshold + 1
    full = (1 << width) - 1
    top = width - 1
    ones = full & ~((1 << t) - 1)  # rows 0 .. t of the first column rise by one each
    # Bit k of the match word says that row j - t + k of a holds the code point of b in column j.
    match = " | ".join(f"IF(element_at(s.xs, j + {k}) = element_at(s.ys, j), {1 << k}L, 0L)" for k in range(width))
    last = f"CAST({top} - (j + {t} - s.n) AS INT)"  # the bit of the last row
    step = f"""named_struct('xs', s.xs, 'ys', s.ys, 'n', s.n,
        'vp', (w.d & s.vp) | (~(shiftrightunsigned(w.d, 1) | w.hp) & {full}L),
        'vn', shiftrightunsigned(w.d, 1) & w.hp,
        'score', IF(j + {t} <= s.n, s.score + IF((w.d & {1 << top}L) = 0, 1L, 0L),
          s.score + (shiftrightunsigned(w.hp, {last}) & 1L) - (shiftrightunsigned(w.d & s.vp, {last}) & 1L)))"""
    step = let("named_struct('d', d, 'hp', s.vn | (~(d | s.vp) & " + f"{full}L))", "w", step)
    step = let(f"((((m & s.vp) + s.vp) ^ s.vp) | m | s.vn) & {full}L", "d", step)
    step = let(match, "m", step)
    pad = ", ".join(["''"] * t)
    # xs: t empty places, the code points of a, and more empty places, so the band never leaves it.
    start = f"""named_struct('xs', concat(array({pad}), split({a}, ''), array({pad}, {pad}, '')), 'ys', split({b}, ''), 'n', CAST(length({a}) AS INT),
        'vp', {ones}L, 'vn', 0L, 'score', CAST(least(length({a}), {t}) AS BIGINT))"""
    run = f"aggregate(sequence(1, CAST(length({b}) AS INT)), {start}, (s, j) -> IF(s.score > {3 * t}L, s, {step}), s -> s.score <= {t})"
    return f"CASE WHEN length({b}) - length({a}) > {t} THEN false WHEN length({b}) <= {t} THEN true ELSE {run} END"


def within(a: str, b: str, threshold: int) -> str:
    """SQL text: whether strings a and b, a not longer, are within the threshold; common ends are cut off first."""
    cut = "named_struct('x', substring({p}.x, 1, CAST(length({p}.x) - tail AS INT)), 'y', substring({p}.y, 1, CAST(length({p}.y) - tail AS INT)))".replace("{p}", "p")
    last = let(cut, "q", banded_distance("q.x", "q.y", threshold))
    turned = let("named_struct('x', reverse(p.x), 'y', reverse(p.y))", "r", _common_prefix("r.x", "r.y"))
    ends = let(turned, "tail", last)
    heads = let(f"named_struct('x', substring({a}, CAST(head + 1 AS INT)), 'y', substring({b}, CAST(head + 1 AS INT)))", "p", ends)
    return let(_common_prefix(a, b), "head", heads)


def near(short: str, long: str, threshold: int) -> str:
    """SQL text: whether two lines are within the edits that the shorter one allows."""
    cases = " ".join(f"WHEN least({threshold}, length({short}) DIV {CHARS_PER_EDIT}) = {k} THEN {within(short, long, k)}" for k in range(threshold, 0, -1))
    return f"CASE {cases} ELSE false END"


def meetings(distinct: DataFrame, threshold: int, tables: Tables) -> DataFrame:
    """(key, h, own, leader, many): probes that meet an index key which is not the line's alone.

    leader: of the key's owners, the one that stands in the document with the least id;
    many: it has other owners; own: the probe is itself a row of the index.
    """
    order = F.coalesce(F.expr("try_cast(first.id AS BIGINT)"), F.lit(-(2**63))).alias("id")
    indexed = _keyed(distinct, index_places(threshold), threshold, [order])
    led = indexed.groupBy("key").agg(F.min_by("h", "id").alias("leader"), (F.min("h") != F.max("h")).alias("many"))
    probes = _keyed(distinct, probe_places(threshold), threshold, [F.col("own")])
    # Leaders are a table, so that adaptive execution can split the probes of a hot key.
    return probes.join(tables.written(led, "line-leaders").hint("shuffle_hash"), "key").where("many OR leader <> h")


def signature(acting: DataFrame) -> DataFrame:
    """(h, s0 .. s7) of lines: parities of their pairs of neighbouring characters."""
    pairs = acting.select("h", F.expr(let("split(line, '')", "cs", "arrays_zip(cs, slice(cs, 2, size(cs)))")).alias("z")).select("h", F.explode("z").alias("z"))
    hashed = pairs.select("h", F.xxhash64(F.col("z")["cs"], F.col("z")["1"]).alias("b"))
    bit = "shiftleft(1L, CAST(shiftright(b, 3) & 63 AS INT))"
    return hashed.groupBy("h").agg(*(F.expr(f"bit_xor(IF((b & {WORDS - 1}) = {w}, {bit}, 0L))").alias(f"s{w}") for w in range(WORDS)))


def _flips(a: str, b: str) -> Column:
    return F.expr(" + ".join(f"bit_count({a}.s{w} ^ {b}.s{w})" for w in range(WORDS)))


def _later(pairs: DataFrame, actors: DataFrame, threshold: int) -> DataFrame:
    """(h): the later line of each pair (x, y) that is near."""
    side = lambda name: actors.select(F.col("h").alias(name), F.struct("line", "n", "first", *(f"s{w}" for w in range(WORDS))).alias(name + "_"))
    both = pairs.join(side("x"), "x").join(side("y"), "y")
    fits = F.expr(f"abs(x_.n - y_.n) <= least({threshold}, least(x_.n, y_.n) DIV {CHARS_PER_EDIT})")
    close = both.where(fits & (_flips("x_", "y_") <= F.expr(f"{FLIPS} * least({threshold}, least(x_.n, y_.n) DIV {CHARS_PER_EDIT})")))
    ordered = close.select(F.expr("IF(x_.first < y_.first, y, x)").alias("h"), F.expr("IF(x_.n <= y_.n, x_.line, y_.line)").alias("short"), F.expr("IF(x_.n <= y_.n, y_.line, x_.line)").alias("long"))
    return ordered.where(F.expr(near("short", "long", threshold))).select("h").distinct()


def near_earlier(distinct: DataFrame, threshold: int, tables: Tables) -> DataFrame:
    """(h): the lines that have a near line standing earlier."""
    met = tables.written(meetings(distinct, threshold, tables), "line-meetings")
    first_pairs = met.where("h <> leader").select(F.greatest("h", "leader").alias("x"), F.least("h", "leader").alias("y")).distinct()
    roles = first_pairs.select(F.explode(F.array("x", "y")).alias("h")).unionByName(met.where("many").select("h")).distinct()
    acting = tables.written(distinct.join(small(tables.written(roles, "line-roles")), "h", "left_semi"), "acting-lines")
    actors = tables.written(acting.join(signature(acting), "h"), "line-actors")
    settled = tables.written(_later(first_pairs, actors, threshold), "lines-settled")
    flags = settled.withColumn("done", F.lit(True))
    known = actors.drop("line").join(flags, "h", "left").withColumn("done", F.coalesce("done", F.lit(False)))
    hot = tables.written(met.where("many").join(known, "h"), "line-hot-keys")
    a, b = hot.alias("a"), hot.where("own").alias("b")
    # Every probe of a key has met its leader.  Lines of one length find each other twice.
    fresh = F.expr("a.h <> a.leader AND b.h <> a.leader AND (b.n < a.n OR a.h < b.h) AND NOT IF(a.first > b.first, a.done, b.done)")
    more = a.join(b, (F.col("a.key") == F.col("b.key")) & fresh & (_flips("a", "b") <= FLIPS * threshold)).select(F.col("a.h").alias("x"), F.col("b.h").alias("y")).distinct()
    return settled.unionByName(_later(tables.written(more, "line-pairs"), actors, threshold)).distinct()


def decisions(lines: DataFrame, threshold: int) -> DataFrame:
    """(h, first, near) of the lines that have copies or an earlier near line: first (id, row, pos) of copies, and whether there is such a line."""
    tables = Tables(lines.sparkSession)
    repeated = repeated_lines(lines, tables)
    distinct = tables.written(distinct_lines(lines, repeated), "distinct-lines")
    gone = near_earlier(distinct, threshold, tables).withColumn("near", F.lit(True))
    both = repeated.where("single").select("h", "first").join(gone, "h", "full")
    found = written(both.select("h", "first", F.coalesce("near", F.lit(False)).alias("near")), "line-decisions")
    tables.drop()
    return found


def removals(df: DataFrame, id_col: str, text_col: str, threshold: int) -> DataFrame:
    """(id, row, removed, n_near): the numbers of the lines to remove, from 0; of them, those that have an earlier near line."""
    lines = lines_of(df, id_col, text_col)
    found = small(decisions(lines, threshold))
    gone = lines.select("id", "row", "pos", "h").join(found, "h").where("near OR first < struct(id, row, pos)")
    rows = gone.groupBy("id", "row").agg(F.array_sort(F.collect_set("pos")).alias("removed"), F.collect_set(F.when(F.col("near"), F.col("pos"))).alias("near"))
    return rows.select("id", "row", "removed", F.size("near").cast("long").alias("n_near"))


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 2) -> DataFrame:
    """(id, n_lines, n_near, removed) of every row: removed are the numbers of the lines to remove, from 0.

    n_near: the removed lines that have an earlier line near them; the others are later
    copies.  Blank lines (blanks, tabs, returns) stay.  A null text has no lines, an empty
    one has one.  Rows that repeat an id come in the order of a hash of their texts; those
    that repeat id and text are one document and get the same row each.  A null id comes
    before all others.  An empty table gives no rows; other columns are not read.
    """
    found = removals(df, id_col, text_col, threshold).withColumnsRenamed({"id": "_id", "row": "_row"})
    plain = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("row"), F.coalesce(F.size(F.split(text_col, "\n")), F.lit(0)).cast("long").alias("n_lines"))
    plain = plain.withColumn("n_lines", F.greatest("n_lines", F.lit(0)))
    joined = plain.join(found, F.col("id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row")), "left")
    none = F.expr("CAST(array() AS array<int>)")
    return joined.select(F.col("id").alias(id_col), "n_lines", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.coalesce("removed", none).alias("removed"))


def clean(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 2) -> DataFrame:
    """df with the removed lines cut out of its texts; every other column as it was, whatever its name."""
    i, row, gone = unused(df, "_id", "_row", "_removed")
    found = removals(df, id_col, text_col, threshold).select(F.col("id").alias(i), F.col("row").alias(row), F.col("removed").alias(gone))
    keep = F.expr(let(f"split(`{text_col}`, '\\n')", "ls_", f"array_join(transform(array_except(sequence(0, size(ls_) - 1), `{gone}`), i_ -> ls_[i_]), '\\n')"))
    joined = df.join(found, F.col(id_col).eqNullSafe(F.col(i)) & (F.xxhash64(text_col) == F.col(row)), "left")
    return joined.withColumn(text_col, F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(keep)).select(df.columns)
