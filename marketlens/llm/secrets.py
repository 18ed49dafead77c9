"""Secrets in texts (operator 1), in DataFrame functions only.

Base spans come from three patterns: assignments, access keys, hexadecimal
runs.  The method adds spans by a battery of randomness tests on every other
run of 20 or more characters of an encoding's alphabet that mixes letters and
digits:

* the encoding (hexadecimal, base 32, base 62, base 64) is inferred from the
  characters, and the characters become symbol numbers 0..k-1;
* chi-squared test of uniform symbols (moments of the multinomial, so short
  runs count right; Wilson-Hilferty tail), runs test about the middle of the
  alphabet, lag-1 serial correlation; Fisher's method joins the p-values;
* false-discovery control within (encoding, length class), over all documents:
  random runs have uniform p-values, so twice those above one half estimate
  their number; the threshold is the least at which the estimated share of
  non-random runs among the reported ones is at most FDR.  Short runs, on which
  the tests see little, thus meet a stricter rule than long ones.

The p-values' histogram (a few hundred strata by 200 bins at most) is the only
thing that meets anywhere; thresholds return as literals.  Everything else is
local to a row: no key, source or group of copies can be hot.

A pattern is looked for where a plainer one, which is found wherever it is, is
found (``NEAR_ASSIGN``, ``NEAR_REST``).

Cases: a null text is an empty text without spans; empty table: no rows; long
texts and long runs are scanned whole, and work grows with their length alone:
positions, overlaps and cuts of thousands of matches come from blocked sums and
maxima, symbols of a run from one pass over it; repeated rows give repeated
results; extra columns are kept by ``redact`` and not read otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm.common import materialise, read_table, whole_row

# The base patterns, and the least length of what they match.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 12
# Runs that fail their length hold no match that reaches it.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "random")

#: Runs that the battery tests.
LEAST = 20
RUN = rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{LEAST},}}"

#: Found in every text with an assignment that counts; in every text with a
#: match of another pattern (16 is the shortest of them).
NEAR_ASSIGN = rf"""[:=]\x20*["']?[A-Za-z0-9+/_.=-]{{{ASSIGN_VALUE}}}"""
NEAR_REST = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16}"

_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: encoding: (characters, alphabet in symbol order); the first that fits holds
ENCODINGS = {
    "hex": ("[0-9a-f]+|[0-9A-F]+", _DIGITS + "abcdef"),
    "base32": ("[A-Z2-7]+", _UPPER + "234567"),
    "base62": ("[A-Za-z0-9]+", _UPPER + _LOWER + _DIGITS),
    "base64": ("[A-Za-z0-9+/_-]+", _UPPER + _LOWER + _DIGITS + "+/"),
}
#: Estimated share of non-random runs among those reported, at most.
FDR = 0.1
BINS = 200
#: p-values above it count as random runs.
STOREY = 0.5
_BLOCK = 256


def _let(name: str, value: str, body: str) -> str:
    """SQL of ``body``, in which ``name`` stands for ``value``, computed once (a
    column may be computed again for every element of an array that names it)."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _earlier(values: str) -> str:
    """SQL: for each of an array of longs of 0 or more, the largest before it,
    or -1; block by block."""
    inside = f"array_max(slice(e_a, cast(i div {_BLOCK} as int) * {_BLOCK} + 1, cast(i % {_BLOCK} as int)))"
    out = f"transform(e_a, (x, i) -> greatest(-1L, e_h[cast(i div {_BLOCK} as int)], {inside}))"
    out = _let("e_h", "transform(e_m, (x, b) -> array_max(slice(e_m, 1, b)))", out)
    out = _let("e_m", f"transform(sequence(0, cast((size(e_a) - 1) div {_BLOCK} as int)), b -> array_max(slice(e_a, b * {_BLOCK} + 1, {_BLOCK})))", out)
    return _let("e_a", values, out)


def _starts(pieces: str, matches: str) -> str:
    """SQL of the start of each match: lengths of the pieces up to it and of
    the matches before it, summed in blocks."""
    out = f"""transform(sequence(0, size({matches}) - 1), i ->
        s_h[cast(i div {_BLOCK} as int)]
        + aggregate(slice(s_n, cast(i div {_BLOCK} as int) * {_BLOCK} + 1, cast(i % {_BLOCK} as int)), 0L, (a, x) -> a + x)
        + length(s_p[i]))"""
    out = _let("s_h", "transform(s_m, (x, b) -> aggregate(slice(s_m, 1, b), 0L, (a, y) -> a + y))", out)
    out = _let("s_m", f"transform(sequence(0, cast((size(s_n) - 1) div {_BLOCK} as int)), b -> aggregate(slice(s_n, b * {_BLOCK} + 1, {_BLOCK}), 0L, (a, x) -> a + x))", out)
    out = _let("s_n", f"transform({matches}, (x, i) -> cast(length(s_p[i]) + length(x) as long))", out)
    return _let("s_p", pieces, out)


def _located(df: DataFrame, name: str, pattern: str, near: str, more: dict[str, Column] | None = None) -> DataFrame:
    """Adds ``name``: the pattern's leftmost non-overlapping matches in _text
    as an array of (start, end, found), where ``near`` holds."""
    m, p = f"_{name}", f"_{name}_p"
    df = df.withColumn(m, F.when(F.col(near), F.regexp_extract_all("_text", F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
    some = F.size(m) > 0
    df = df.withColumns({p: F.when(some, F.split("_text", pattern, -1)), **(more or {})})
    df = df.withColumn(f"{p}_at", F.when(some, F.expr(_starts(p, m))))
    spans = F.when(some, F.expr(_let("l_at", f"{p}_at", f"transform({m}, (x, i) -> struct(l_at[i] as start, l_at[i] + length(x) as end, x as found))")))
    return df.withColumn(name, F.coalesce(spans, F.expr("cast(array() as array<struct<start:bigint,end:bigint,found:string>>)")))


def _apart(runs: str, base: str) -> str:
    """SQL: the runs (in order) that overlap no base span: of those that start
    up to a run none ends beyond its start, and none starts later within it."""
    both = f"""array_sort(concat(
        transform({base}, b -> struct(b.start as start, false as run, b.end as end, '' as found)),
        transform({runs}, r -> struct(r.start as start, true as run, r.end as end, r.found as found))))"""
    far = "transform(a_s, x -> if(x.run, -1L, x.end))"
    # counted from the end of the text, so that the next start is the largest
    near = "reverse(transform(a_s, x -> if(x.run, -1L, a_n - x.start)))"
    out = "transform(filter(a_s, (x, i) -> x.run and a_far[i] <= x.start and a_near[i] <= a_n - x.end), x -> struct(x.start as start, x.end as end, x.found as found))"
    out = _let("a_near", f"reverse({_earlier(near)})", out)
    out = _let("a_far", _earlier(far), out)
    out = _let("a_n", "array_max(transform(a_s, x -> x.end))", out)
    return f"case when size({base}) = 0 or size({runs}) = 0 then {runs} else {_let('a_s', both, out)} end"


def _tail(z: str) -> str:
    """SQL of the standard normal's upper tail (Abramowitz and Stegun 26.2.17)."""
    t = f"(1 / (1 + 0.2316419 * abs({z})))"
    upper = f"(exp(-least(abs({z}), 37.0) * least(abs({z}), 37.0) / 2) * 0.3989422804014327 * {t} * (0.319381530 + {t} * (-0.356563782 + {t} * (1.781477937 + {t} * (-1.821255978 + {t} * 1.330274429)))))"
    return f"(case when {z} >= 0 then {upper} else 1 - {upper} end)"


def _tested(runs: str) -> str:
    """SQL: the runs (array of start, end, found) with encoding, length class
    and p-value of the battery; others than mixes of letters and digits go."""
    kept = f"filter({runs}, r -> r.found rlike '[0-9]' and r.found rlike '[A-Za-z]')"
    enc = "case " + " ".join(f"when r.found rlike '^({p})$' then '{e}'" for e, (p, _) in ENCODINGS.items()) + " end"
    step = f"transform({kept}, r -> struct(r.start as start, r.end as end, r.found as found, {enc} as enc))"
    alphabet = "case r.enc " + " ".join(f"when '{e}' then '{a}'" for e, (_, a) in ENCODINGS.items()) + " end"
    size = "case r.enc " + " ".join(f"when '{e}' then {len(a)}D" for e, (_, a) in ENCODINGS.items()) + " end"
    text = "case r.enc when 'hex' then lower(r.found) when 'base64' then translate(r.found, '-_', '+/') else r.found end"
    step = f"transform({step}, r -> struct(r.start as start, r.end as end, r.enc as enc, cast(length(r.found) as double) as n, {size} as k, {alphabet} as abc, {text} as text))"
    x = "transform(filter(split(r.text, ''), c -> c <> ''), c -> cast(instr(r.abc, c) - 1 as double))"
    count = "cast(length(r.text) - length(replace(r.text, substr(r.abc, i, 1), '')) as double)"
    squares = f"aggregate(transform(sequence(1, length(r.abc)), i -> {count}), 0D, (a, c) -> a + c * c)"
    step = f"transform({step}, r -> struct(r.start as start, r.end as end, r.enc as enc, r.n as n, r.k as k, {squares} as squares, {x} as x))"
    high = "aggregate(r.x, 0D, (a, s) -> a + if(s >= r.k / 2, 1D, 0D))"
    turns = "aggregate(sequence(1, size(r.x) - 1), 1D, (a, i) -> a + if((r.x[i] >= r.k / 2) <> (r.x[i - 1] >= r.k / 2), 1D, 0D))"
    lag = "aggregate(sequence(1, size(r.x) - 1), 0D, (a, i) -> a + (r.x[i] - (r.k - 1) / 2) * (r.x[i - 1] - (r.k - 1) / 2))"
    keep = "r.start as start, r.end as end, r.enc as enc, r.n as n"
    step = f"transform({step}, r -> struct({keep}, r.k as k, r.k / r.n * r.squares - r.n as chi, {high} as high, {turns} as turns, {lag} as lag))"
    # gamma of the statistic's own mean k - 1 and variance 2 (k - 1)(n - 1) / n
    df = "((r.k - 1) * r.n / (r.n - 1))"
    ratio = "(greatest(r.chi, 0D) / (r.k - 1))"
    z_chi = f"((power({ratio}, 1D / 3) - (1 - 2 / (9 * {df}))) / sqrt(2 / (9 * {df})))"
    both = "(2 * r.high * (r.n - r.high))"
    z_runs = f"(case when r.high in (0, r.n) then 37D else (r.turns - {both} / r.n - 1) / sqrt(greatest({both} * ({both} - r.n) / (r.n * r.n * (r.n - 1)), 1e-9)) end)"
    z_lag = "(r.lag / ((r.k * r.k - 1) / 12) / sqrt(r.n - 1))"
    step = f"transform({step}, r -> struct({keep}, {z_chi} as z1, abs({z_runs}) as z2, abs({z_lag}) as z3))"
    least = lambda p: f"ln(greatest({p}, 1e-300))"
    step = f"transform({step}, r -> struct({keep}, -({least(_tail('r.z1'))} + {least('2 * ' + _tail('r.z2'))} + {least('2 * ' + _tail('r.z3'))}) as s))"
    return f"transform({step}, r -> struct(r.start as start, r.end as end, r.enc as enc, cast(floor(2 * log2(r.n)) as int) as size, least(1D, exp(-r.s) * (1 + r.s + r.s * r.s / 2)) as p))"


def _scanned(docs: DataFrame, text_col: str) -> DataFrame:
    """The rows as struct _row, with _base (base spans) and _runs (tested runs
    that overlap no base span)."""
    df = docs.select(whole_row(docs).alias("_row"), F.coalesce(docs[text_col], F.lit("")).alias("_text"))
    df = df.withColumns({"_near": F.col("_text").rlike(NEAR_ASSIGN), "_near_rest": F.col("_text").rlike(NEAR_REST)})
    values = {"_assign_v": F.when(F.size("_assign") > 0, F.regexp_extract_all("_text", F.lit(ASSIGN), F.lit(2)))}
    df = _located(df, "assign", ASSIGN, "_near", values)
    df = _located(df, "access", ACCESS, "_near_rest")
    df = _located(df, "hex", HEX, "_near_rest")
    df = _located(df, "run", RUN, "_near_rest")
    span = lambda k: f"x -> struct(x.start as start, {KINDS.index(k)} as ord, x.end as end, '{k}' as kind)"
    long = f"filter(assign, (x, i) -> length(_assign_v[i]) >= {ASSIGN_VALUE})"
    base = ", ".join(f"transform({long if k == 'assign' else k}, {span(k)})" for k in KINDS[:3])
    df = df.select("_row", "_text", "run", F.expr(f"array_sort(concat({base}))").alias("_base"))
    df = df.withColumn("run", F.expr(_apart("run", "_base")))
    return df.select("_row", "_text", "_base", F.expr(_tested("run")).alias("_runs"))


def _thresholds(scanned: DataFrame) -> str:
    """SQL of the least p-value reported, by encoding and length class of r."""
    # explode() would have the runs tested once more, to see which rows have any
    counts = scanned.select(F.explode_outer("_runs").alias("r")).where("r is not null").groupBy("r.enc", "r.size", F.least(F.lit(BINS - 1), F.floor(F.col("r.p") * BINS)).alias("bin")).count()
    strata: dict[tuple[str, int], list[int]] = {}
    for r in counts.collect():  # encodings x length classes x BINS at most
        strata.setdefault((r["enc"], r["size"]), [0] * BINS)[r["bin"]] += r["count"]
    cases = []
    for (enc, size), hist in sorted(strata.items()):
        above = int(BINS * STOREY)
        random = min(sum(hist), sum(hist[above:]) / (1 - STOREY))
        left = sum(hist)
        for b in range(BINS):
            if b and left and 1 - random * (1 - b / BINS) / left <= FDR:
                cases.append(f"when r.enc = '{enc}' and r.size = {size} then {b / BINS!r}D")
                break
            left -= hist[b]
    return f"case {' '.join(cases)} else 2D end" if cases else "2D"


def _reported(scanned: DataFrame, thresholds: str) -> DataFrame:
    random = f"transform(filter(_runs, r -> r.p >= {thresholds}), r -> struct(r.start as start, {len(KINDS) - 1} as ord, r.end as end, '{KINDS[-1]}' as kind))"
    return scanned.withColumn("_spans", F.expr(f"array_sort(concat(_base, {random}))"))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, base and spans, arrays of (start,
    ord, end, kind) in code points."""
    src = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    found = materialise(_scanned(src, "text").select(F.col("_row.doc_id").alias("doc_id"), "_base", "_runs"), "secrets-runs")
    return _reported(found, _thresholds(found)).select("doc_id", F.col("_base").alias("base"), F.col("_spans").alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The rows of ``docs`` with each reported span (overlapping ones as one)
    replaced by ``mark``; other columns as they are."""
    scanned = _scanned(docs, text_col)
    found = _reported(scanned, _thresholds(scanned.select("_runs")))
    groups = "filter(transform(_spans, (s, i) -> struct(s.start as start, c_far[i] as before)), s -> s.start > s.before)"
    joined = "transform(c_g, (s, i) -> struct(s.start as start, coalesce(get(c_g, i + 1).before, c_end) as end))"
    joined = _let("c_g", groups, _let("c_end", "array_max(transform(_spans, s -> s.end))", joined))
    joined = _let("c_far", _earlier("transform(_spans, s -> s.end)"), joined)
    none = F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")
    found = found.withColumn("_cut", F.when(F.size("_spans") > 0, F.expr(joined)).otherwise(none))

    def part(start: str, end: str) -> str:  # of the text in pieces of _BLOCK characters
        lo, hi = f"cast({start} div {_BLOCK} as int)", f"cast(({end} - 1) div {_BLOCK} as int)"
        return f"if({end} > {start}, substring(array_join(slice(p_t, {lo} + 1, {hi} - {lo} + 1), ''), cast({start} % {_BLOCK} as int) + 1, cast({end} - {start} as int)), '')"

    clean = f"transform(p_c, (s, i) -> concat({part('if(i = 0, 0L, p_c[i - 1].end)', 's.start')}, '{mark}'))"
    clean = f"concat(array_join({clean}, ''), {part('element_at(p_c, -1).end', 'cast(length(_text) as long)')})"
    pieces = f"regexp_extract_all(_text, '(?s).{{1,{_BLOCK}}}', 0)"
    clean = _let("p_c", "_cut", _let("p_t", pieces, clean))
    text = F.when(F.size("_cut") > 0, F.expr(clean)).otherwise(F.col(f"_row.`{text_col}`"))
    return found.select(*[(text if c == text_col else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def digests(found: DataFrame) -> DataFrame:
    """The contract's columns of ``spans``' rows."""
    listed = "array_join(transform({}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"
    return found.selectExpr(
        "doc_id",
        *(f"cast(size(filter(base, s -> s.kind = '{k}')) as long) as n_{k}" for k in KINDS[:3]),
        f"sha2({listed.format('base')}, 256) as base_sha256",
        f"{listed.format('spans')} as spans",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spans(read_table(spark, sf_dir, "documents")))
