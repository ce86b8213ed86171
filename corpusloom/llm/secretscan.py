"""Secret scans: fixed patterns, and a randomness test battery, in DataFrame and SQL functions alone.

Base spans come from three fixed patterns.  Further spans are tokens that look random.
A candidate is a maximal run of the characters of base64 and base64url, 20 or more, that
no base span overlaps, and whose encoding can be inferred:

    hex     one case of letters, a digit and a letter, nothing else    16 symbols
    base36  one case of letters and digits                             36 symbols
    base64  both cases and a digit, +/ or -_ besides                   64 symbols

Battery: three tests of the hypothesis that the symbols are uniform and independent.

    chi-squared   uniformity over the inferred alphabet (too uneven)
    runs          of symbols of the alphabet's lower and upper half (too few or many)
    serial        correlation of neighbouring symbols (away from none)

The smallest of the three p-values times three (Bonferroni) is the battery's p-value.

Length-aware false-discovery control, over the candidates of a document, in two steps.
All p-values are weighted: divided by the token's length relative to the mean length, as
longer tokens say more.

    not random   the Benjamini-Hochberg rule at level ``Q_RANDOM`` over the battery's
                 p-values; tokens that it rejects are dropped
    not text     a short token passes such tests by chance.  So each token gets the
                 probability that text of its length is as even as it is: the equal pairs
                 of symbols, which carry the chi-squared value, are compared with what
                 letters of running text give; for hex, it is the probability that text
                 uses hex symbols alone.  The rule at level ``Q`` over these decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.shared import unused
from corpusloom.llm.sqltext import let

#: Kinds in their order, and the base patterns.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGNED = 12
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
#: The alphabets, in the order of their symbols.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
Q_RANDOM, Q = 0.001, 0.02
#: Matches of a text that sums run over at once.
BLOCK = 256
#: Probability that two letters of running text are equal, and that one is a hex symbol.
TEXT_COLLISION, TEXT_HEX = 0.065, 0.35


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _placed(text: str, pattern: str, group: int, rank: int, least: int) -> str:
    """SQL text: array of (start, rank, end, body) of all matches whose group is long enough.

    The pieces between the matches give the places: a match starts after all pieces and
    matches before it, in code points.  Sums run over blocks of BLOCK matches, so that
    appending to arrays stays short for texts of very many matches.
    """
    p = _quoted(pattern)
    kind = "array<struct<start:int,rank:int,end:int,body:string>>"
    size = "length(m.`0`) + coalesce(length(m.`1`), 0)"
    block = f"slice(z, j * {BLOCK} + 1, {BLOCK})"
    ends = f"aggregate(js, array(0), (s, j) -> array_append(s, element_at(s, -1) + aggregate({block}, 0, (n, m) -> n + {size})))"
    places = f"""aggregate({block}, named_struct('at', element_at(ends, j + 1), 'found', CAST(array() AS {kind})),
        (s, m) -> named_struct(
          'at', s.at + {size},
          'found', IF(m.`1` IS NULL OR length(m.`2`) < {least}, s.found,
            array_append(s.found, named_struct('start', s.at + length(m.`0`), 'rank', {rank}, 'end', s.at + length(m.`0`) + length(m.`1`), 'body', m.`1`)))),
        s -> s.found)"""
    found = let(ends, "ends", f"flatten(transform(js, j -> {places}))")
    blocks = let(f"sequence(0, CAST((size(z) - 1) DIV {BLOCK} AS INT))", "js", found)
    zipped = f"arrays_zip(split({text}, {p}, -1), regexp_extract_all({text}, {p}, 0), regexp_extract_all({text}, {p}, {group}))"
    return f"IF(NOT {text} RLIKE {p}, CAST(array() AS {kind}), {let(zipped, 'z', blocks)})"


def _apart(candidates: str, base: str) -> str:
    """SQL text: the candidates that no base span overlaps; base is sorted, and asked by blocks."""
    last = f"CAST((size({base}) - 1) DIV {BLOCK} AS INT)"
    block = let(f"slice({base}, j * {BLOCK} + 1, {BLOCK})", "b", "named_struct('lo', b[0].start, 'hi', array_max(transform(b, x -> x.end)), 'spans', b)")
    blocks = f"IF(size({base}) = 0, array(), transform(sequence(0, {last}), j -> {block}))"
    hit = "exists(bs, k -> k.lo < c.end AND c.start < k.hi AND exists(k.spans, x -> x.start < c.end AND c.start < x.end))"
    return f"IF(size({base}) = 0, {candidates}, {let(blocks, 'bs', f'filter({candidates}, c -> NOT {hit})')})"


def base_spans(text: str) -> str:
    """SQL text: the base spans by start, then kind."""
    parts = (_placed(text, ASSIGN, 2, 0, ASSIGNED), _placed(text, ACCESS, 0, 1, 0), _placed(text, HEX, 0, 2, 0))
    return f"array_sort(concat({', '.join(parts)}))"


def normal_cdf(z: str) -> str:
    """SQL text: the normal distribution function by a logistic curve in z and its cube."""
    return f"(1.0D / (1.0D + exp(-least(greatest(1.5976D * ({z}) + 0.07056D * pow({z}, 3), -700D), 700D))))"


def _measured() -> str:
    """SQL text: a candidate c (start, rank, end, body) with its encoding, test values and p-value."""
    encoding = """CASE WHEN NOT c.body RLIKE '[0-9]' OR NOT c.body RLIKE '[A-Za-z]' THEN NULL
      WHEN c.body RLIKE '^[0-9a-f]+$' OR c.body RLIKE '^[0-9A-F]+$' THEN 'hex'
      WHEN c.body RLIKE '^[0-9a-z]+$' OR c.body RLIKE '^[0-9A-Z]+$' THEN 'base36'
      WHEN c.body RLIKE '[a-z]' AND c.body RLIKE '[A-Z]' THEN 'base64' END"""
    symbols = f"""CASE e WHEN 'hex' THEN transform(split(lower(c.body), ''), x -> locate(x, '{ALPHABETS['hex']}') - 1)
      WHEN 'base36' THEN transform(split(lower(c.body), ''), x -> locate(x, '{ALPHABETS['base36']}') - 1)
      ELSE transform(split(translate(c.body, '-_', '+/'), ''), x -> locate(x, '{ALPHABETS['base64']}') - 1) END"""
    size = "CASE e WHEN 'hex' THEN 16 WHEN 'base36' THEN 36 ELSE 64 END"
    # Equal pairs of symbols carry both the chi-squared value and the collision test.
    pairs = "aggregate(transform(sequence(0, k - 1), i -> CAST(size(filter(v, y -> y = i)) AS DOUBLE)), 0D, (s, y) -> s + y * (y - 1) / 2)"
    upper = "CAST(size(filter(v, y -> 2 * y >= k)) AS DOUBLE)"
    runs = "CAST(1 + size(filter(sequence(1, n - 1), i -> (2 * v[i] >= k) <> (2 * v[i - 1] >= k))) AS DOUBLE)"
    mean = "(k - 1) / 2.0D"
    lagged = f"aggregate(sequence(1, n - 1), 0D, (s, i) -> s + (v[i] - {mean}) * (v[i - 1] - {mean}))"
    spread = "((k * k - 1) / 12.0D)"
    z_chi = "((2 * q * k / n + k - n - (k - 1)) / sqrt(2.0D * (k - 1) * (n - 1) / n))"
    z_runs = "IF(u = 0 OR u = n, 99D, (r - (2 * u * (n - u) / n + 1)) / sqrt(greatest(2 * u * (n - u) * (2 * u * (n - u) - n) / (n * n * (n - 1.0D)), 1e-9D)))"
    z_serial = f"({lagged} / ({spread} * sqrt(n - 1.0D)))"
    expected = f"(n * (n - 1) / 2.0D * {TEXT_COLLISION}D)"
    deviation = f"sqrt({expected} * {1 - TEXT_COLLISION}D + n * (n - 1.0D) * (n - 2) * 0.0006D)"
    p_text = f"IF(k = 16, pow({TEXT_HEX}D, CAST(size(filter(v, y -> y > 9)) AS DOUBLE)), {normal_cdf(f'(q - {expected}) / {deviation}')})"
    upper_tail = lambda z: f"(1.0D - {normal_cdf(z)})"
    p_battery = f"least(1.0D, 3 * least({upper_tail(z_chi)}, 2 * {upper_tail(f'abs({z_runs})')}, 2 * {upper_tail(f'abs({z_serial})')}))"
    out = f"named_struct('start', c.start, 'rank', 3, 'end', c.end, 'body', c.body, 'n', n, 'p_battery', {p_battery}, 'p', {p_text})"
    inner = let(upper, "u", let(runs, "r", out))
    inner = let("size(v)", "n", let(size, "k", let(pairs, "q", inner)))
    return let(encoding, "e", f"IF(e IS NULL, NULL, {let(symbols, 'v', inner)})")


def _chosen(m: str) -> str:
    """SQL text: of the measured candidates those that both false-discovery steps leave."""
    mean = f"(aggregate({m}, 0D, (s, o) -> s + o.n) / size({m}))"
    weighted = lambda field: f"transform({m}, x -> x.{field} / (x.n / mean))"
    limit = lambda ps, level: f"array_max(transform(array_sort({ps}), (p, i) -> IF(p <= {level}D * (i + 1) / size({ps}), p, -1D)))"
    judged = f"transform({m}, (x, i) -> named_struct('m', x, 'pb', bat[i], 'pt', txt[i]))"
    keep = f"filter({judged}, x -> x.pb > no AND x.pt <= yes)"
    out = f"transform({keep}, x -> named_struct('start', x.m.start, 'rank', 3, 'end', x.m.end, 'body', x.m.body))"
    inner = let(limit("bat", Q_RANDOM), "no", let(limit("txt", Q), "yes", out))
    return let(mean, "mean", let(weighted("p_battery"), "bat", let(weighted("p"), "txt", inner)))


def with_spans(df: DataFrame, text_col: str = "text", base: str = "base", spans: str = "spans") -> DataFrame:
    """df and two columns, base and spans: arrays of (start, rank, end, body), by start and kind.

    Starts and ends are code points of the whole text, the end exclusive; null counts as
    the empty text, which has no spans.  A column that is there under one of the two names
    is replaced; rows may repeat; an empty table gives no rows.
    """
    t, c, m = unused(df, "_t", "_c", "_m")
    kind = "array<struct<start:int,rank:int,end:int,body:string>>"
    found = df.withColumn(t, F.coalesce(text_col, F.lit("")))
    found = found.withColumn(base, F.expr(base_spans(f"`{t}`")))
    found = found.withColumn(c, F.expr(_apart(_placed(f"`{t}`", CANDIDATE, 0, 3, 0), f"`{base}`")))
    found = found.withColumn(m, F.expr(f"IF(size(`{c}`) = 0, NULL, filter(transform(`{c}`, c -> {_measured()}), m -> m IS NOT NULL))"))
    found = found.withColumn(spans, F.expr(f"IF(size(`{m}`) > 0, array_sort(concat(`{base}`, CAST({_chosen(f'`{m}`')} AS {kind}))), `{base}`)"))
    return found.drop(t, c, m)


def listed(spans: str) -> Column:
    """kind:start:end of all spans, comma-joined."""
    kinds = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({spans}, s -> concat(element_at(array({kinds}), s.rank + 1), ':', s.start, ':', s.end)), ',')")


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, spans) of every row, repeated ones too; other columns are not read.  An empty table gives no rows."""
    plain = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return with_spans(plain, "_text").select(F.col("_id").alias(id_col), "base", "spans")


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with each stretch that spans cover replaced by [REDACTED]; other columns as they were, whatever their names.

    Spans that overlap or touch are one stretch.  A text is cut into parts of BLOCK spans
    first, so that no piece is looked for from the text's beginning.
    """
    base, spans = unused(df, "_base", "_spans")
    # Stretches in blocks: within a block spans are joined to stretches; (from, to) pairs.
    join = """aggregate(ss, CAST(array() AS array<struct<a:int,b:int>>), (s, x) -> IF(size(s) > 0 AND x.start <= element_at(s, -1).b,
        concat(slice(s, 1, size(s) - 1), array(named_struct('a', element_at(s, -1).a, 'b', greatest(element_at(s, -1).b, x.end)))),
        array_append(s, named_struct('a', x.start, 'b', x.end))))"""
    last = f"CAST((size(`{spans}`) - 1) DIV {BLOCK} AS INT)"
    blocks = f"transform(sequence(0, {last}), j -> {let(f'slice(`{spans}`, j * {BLOCK} + 1, {BLOCK})', 'ss', join)})"
    # A block's text goes from its first stretch to the next block's; stretches that reach
    # over a block's end are cut off there, as the next block begins inside of them.
    ends = f"transform(bs, (b, j) -> IF(j + 1 < size(bs), bs[j + 1][0].a, length(`{text_col}`)))"
    reach = "aggregate(slice(bs, 1, j), 0, (m, b) -> greatest(m, element_at(b, -1).b))"
    part = f"substring(`{text_col}`, b[0].a + 1, es[j] - b[0].a)"
    pieces = """transform(b, (x, i) -> concat(IF(j > 0 AND x.a <= r, '', '[REDACTED]'),
        substring(t, greatest(x.b, r) - b[0].a + 1, IF(i + 1 < size(b), b[i + 1].a, es[j]) - greatest(x.b, r))))"""
    texts = f"transform(bs, (b, j) -> {let(reach, 'r', let(part, 't', f'array_join({pieces}, {chr(39) * 2})'))})"
    body = let(ends, "es", f"concat(substring(`{text_col}`, 1, bs[0][0].a), array_join({texts}, ''))")
    found = with_spans(df, text_col, base, spans)
    return found.withColumn(text_col, F.expr(f"IF(size(`{spans}`) = 0, `{text_col}`, {let(blocks, 'bs', body)})")).select(df.columns)
