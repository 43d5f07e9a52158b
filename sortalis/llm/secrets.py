"""Secrets in texts, by DataFrame expressions alone.

Base kinds, leftmost and non-overlapping each:

* ``assign``: a password-like name, a separator and a value of six characters or more;
* ``access``: an access key id of twenty characters or more;
* ``hex``: a run of 24 lower-case hexadecimal digits or more.

Method: other candidates are runs of 20 or more characters of the base64 alphabets.  A window of 20
characters slides over a candidate.  Its state is a count for each symbol, five bits each in a few whole
numbers, and a count for each kind of symbol.  When the window moves, only the counts of the character that
enters and of the one that leaves change, and with them the window's weight, the sum of n log2 n, from
which its Shannon entropy follows.  The threshold depends on the characters in the window: hexadecimal
digits, digits and letters, or letters of both cases.  Windows at or over it merge into ``entropy`` spans.
An allow list masks harmless parts of a candidate (UUIDs, dates, path segments with words such as
``example``), and a path of plain words is none; spans inside a base span add nothing.  Sums are whole
numbers (millionths), so a result does not depend on the order of additions.

Cost: a candidate is cut into blocks, each with the characters before it that its first window needs, and
positions are running sums over blocks, so the work is in proportion to the text but for terms that are
small below some millions of matches in one text.

Defined cases: a null text is empty and has no span; positions are code points, ends exclusive; rows that
repeat give the same spans; an empty table gives no row; in ``scanned`` other columns are ignored, in
``redacted`` all columns stay, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
NAMES = "(?i)password|passwd|secret|token|api_?key"
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
CANDIDATE = "[A-Za-z0-9+/_-]{20,}={0,2}"
WINDOW = 20
#: Entropy thresholds in bits, by the characters of a window; letters alone need LEAST_CASE of either case.
HEX_BITS, MIXED_BITS, LETTER_BITS, LEAST_CASE = 3.1, 3.85, 4.0, 4
#: Candidates that are paths of plain words and numbers.
PLAIN = "^/?(?:[A-Za-z]++|[0-9]++)(?:[/_-](?:[A-Za-z]++|[0-9]++))++/?$"
#: Parts of a candidate that are no secrets, with their lengths: UUIDs and dates.
MASKED = (
    ("(?<![0-9A-Za-z])[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}(?![0-9A-Za-z])", 36),
    ("(?<![0-9])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9])", 10),
)
#: A path segment with one of these is no secret.
HARMLESS = "(?i)example|sample|dummy|placeholder|xxxx|0123456789|abcdefgh"
KINDS = ("assign", "access", "hex", "entropy")
MARK = "[SECRET]"
BLOCK, TEXT_BLOCK = 256, 4096

#: n log2 n in millionths, for counts up to the window.
WEIGHTS = [0] + [round(n * math.log2(n) * 1_000_000) for n in range(1, WINDOW + 1)]
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-= "
#: Kinds of symbols, in the order of their five-bit counts.
DIGIT, LOW_HEX, HIGH_HEX, LOW, HIGH, SIGN, MASK = range(7)
PER_WORD = 12
WORDS = -(-len(SYMBOLS) // PER_WORD)


def _kind(symbol: str) -> int:
    if symbol.isdigit():
        return DIGIT
    if symbol.isalpha():
        return (LOW_HEX if symbol in "abcdef" else LOW) if symbol.islower() else (HIGH_HEX if symbol in "ABCDEF" else HIGH)
    return MASK if symbol == " " else SIGN


def most_weight(bits: float) -> int:
    """The largest weight of a window whose entropy is at least ``bits``."""
    return math.floor((math.log2(WINDOW) - bits) * WINDOW * 1_000_000)


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    """SQL of a body in which a name stands for a value that is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _running(values: str, join: Callable[[str, str], str]) -> str:
    """SQL of the running sums or maxima of an array of longs, 0 or more.

    Blocks are accumulated on their own and then shifted, as appending to one long array would copy it each time.
    """
    none = "cast(array() as array<bigint>)"
    start = f"named_struct('a', 0L, 'out', {none})"
    blocks = f"transform(sequence(0L, (size(rv) - 1) div {BLOCK}), k -> slice(rv, cast(k * {BLOCK} + 1 as int), {BLOCK}))"
    inner = f"aggregate(b, {start}, (s, y) -> {_let('now', join('s.a', 'y'), 'named_struct(' + repr('a') + ', now, ' + repr('out') + ', concat(s.out, array(now)))')}, s -> s.out)"
    heads = f"aggregate(rs, {start}, (s, x) -> named_struct('a', {join('s.a', 'element_at(x, -1)')}, 'out', concat(s.out, array(s.a))), s -> s.out)"
    whole = _let("rs", f"transform({blocks}, b -> {inner})", f"flatten(zip_with(rs, {heads}, (x, h) -> transform(x, y -> {join('h', 'y')})))")
    return _let("rv", values, f"if(size(rv) = 0, {none}, {whole})")


SUM, MAX = "{} + {}".format, "greatest({}, {})".format
SPAN = "struct<start:bigint,end:bigint,body:string>"


def _found(text: str, pattern: str, group: int, least: int, guard: str) -> Column:
    """The matches of a pattern as structs (start, end, body), where the group has ``least`` characters or more.

    The texts between the matches come from a split at the same pattern, so positions are running sums of lengths.
    """
    p = _quoted(pattern)
    steps = f"zip_with(w, slice(split({text}, {p}, -1), 1, size(w)), (x, g) -> cast(length(x) + length(g) as bigint))"
    rows = f"zip_with(zip_with({_running(steps, SUM)}, w, (e, x) -> named_struct('start', e - length(x), 'end', e)), regexp_extract_all({text}, {p}, {group}), (x, y) -> named_struct('start', x.start, 'end', x.end, 'body', y))"
    return F.expr(f"case when {guard} then {_let('w', f'regexp_extract_all({text}, {p}, 0)', f'filter({rows}, x -> length(x.body) >= {least})')} else cast(array() as array<{SPAN}>) end")


def _symbol_table() -> str:
    """SQL of an array that has, by ASCII code, a symbol's number, word, bit, shift and the bit of its kind."""
    none = "named_struct('id', {}, 'word', {}, 'bit', {}L, 'shift', {}, 'kind', {}L)"
    rows = []
    for code in range(128):
        i = SYMBOLS.find(chr(code)) if chr(code) in SYMBOLS else len(SYMBOLS) - 1
        shift = 5 * (i % PER_WORD)
        rows.append(none.format(i, i // PER_WORD, 1 << shift, shift, 1 << 5 * _kind(SYMBOLS[i])))
    return f"array({', '.join(rows)})"


def _masked(body: str) -> str:
    """SQL of a candidate with blanks, which no window may hold, in place of its harmless parts."""
    for pattern, length in MASKED:
        body = f"regexp_replace({body}, {_quoted(pattern)}, '{' ' * length}')"
    word = _quoted(HARMLESS)
    return _let("mb", body, f"if(mb rlike {word}, array_join(transform(split(mb, '/'), g -> if(g rlike {word}, repeat(' ', length(g)), g)), '/'), mb)")


def _window_ends(text: str, offset: str) -> str:
    """SQL of the ends, counted from ``offset``, of the windows of a short text that reach their threshold."""
    weights = f"array({', '.join(f'{w}L' for w in WEIGHTS)})"
    outside = "named_struct('id', -1, 'word', -1, 'bit', 0L, 'shift', 0, 'kind', 0L)"
    count = lambda io: f"cast(shiftright(s.counts[greatest({io}.word, 0)], {io}.shift) & 31 as int)"
    gained = f"{weights}[{count('io.i')} + 1] - {weights}[{count('io.i')}]"
    lost = f"if(io.o.id < 0, 0L, {weights}[{count('io.o')}] - {weights}[greatest({count('io.o')} - 1, 0)])"
    weight = f"if(io.i.id = io.o.id, s.weight, s.weight + {gained} - {lost})"
    counts = f"transform(s.counts, (n, k) -> case k when {WORDS} then n + io.i.kind - io.o.kind else n + if(k = io.i.word, io.i.bit, 0L) - if(k = io.o.word, io.o.bit, 0L) end)"
    kind = lambda k: f"(shiftright(t.counts[{WORDS}], {5 * k}) & 31)"
    letters = f"{kind(LOW_HEX)} + {kind(HIGH_HEX)} + {kind(LOW)} + {kind(HIGH)}"
    hexadecimal = f"{kind(LOW)} + {kind(HIGH)} + {kind(SIGN)} = 0 and ({kind(LOW_HEX)} = 0 or {kind(HIGH_HEX)} = 0)"
    cases = f"{kind(SIGN)} = 0 and {kind(LOW_HEX)} + {kind(LOW)} >= {LEAST_CASE} and {kind(HIGH_HEX)} + {kind(HIGH)} >= {LEAST_CASE}"
    limit = f"case when {kind(MASK)} > 0 or {letters} = 0 then -1L when {kind(DIGIT)} = 0 then if({cases}, {most_weight(LETTER_BITS)}L, -1L) when {hexadecimal} then {most_weight(HEX_BITS)}L else {most_weight(MIXED_BITS)}L end"
    start = f"named_struct('at', 0L, 'weight', 0L, 'counts', array_repeat(0L, {WORDS + 1}), 'out', cast(array() as array<bigint>))"
    moved = f"named_struct('at', s.at + 1, 'weight', {weight}, 'counts', {counts})"
    flagged = f"t.at >= {WINDOW} and t.weight <= {most_weight(HEX_BITS)}L and t.weight <= {limit}"
    step = _let("t", moved, f"named_struct('at', t.at, 'weight', t.weight, 'counts', t.counts, 'out', if({flagged}, concat(s.out, array({offset} + t.at)), s.out))")
    codes = f"transform(split({text}, ''), x -> {_symbol_table()}[ascii(x)])"
    return _let("codes", codes, f"aggregate(zip_with(codes, slice(concat(array_repeat({outside}, {WINDOW}), codes), 1, size(codes)), (i, o) -> named_struct('i', i, 'o', o)), {start}, (s, io) -> {step}, s -> s.out)")


def _entropy_spans(candidates: str) -> Column:
    """The merged windows of the candidates whose entropy reaches the threshold."""
    before = f"if(k = 0, '', substr(bs[k - 1], -{WINDOW - 1}))"
    block = _let("bt", f"concat({before}, b)", _window_ends("bt", f"cast(k * {BLOCK} - length({before}) as bigint)"))
    ends = _let("bs", f"regexp_extract_all({_masked('c.body')}, '(?s).{{1,{BLOCK}}}', 0)", f"flatten(transform(bs, (b, k) -> {block}))")
    heads = f"filter(e, (x, i) -> i = 0 or x - {WINDOW} > e[greatest(i - 1, 0)])"
    tails = f"filter(e, (x, i) -> i = size(e) - 1 or e[least(i + 1, size(e) - 1)] - {WINDOW} > x)"
    merged = _let("e", ends, f"zip_with({heads}, {tails}, (a, z) -> named_struct('start', c.start + a - {WINDOW}, 'end', c.start + z))")
    return F.expr(f"flatten(transform(filter({candidates}, c -> not c.body rlike {_quoted(PLAIN)}), c -> {merged}))")


def _with_spans(texts: DataFrame) -> DataFrame:
    """Adds to a frame with a text ``t``: the base kinds, ``base`` and ``spans``, structs (start, kind, end) in order."""
    out = texts.withColumn("assign", _found("t", ASSIGN, 1, 6, f"t rlike {_quoted(NAMES)}"))
    out = out.withColumn("access", _found("t", ACCESS, 0, 20, "contains(t, 'AKIA')"))
    out = out.withColumn("hex", _found("t", HEX, 0, 24, "t rlike '[0-9a-f]{24}'"))
    out = out.withColumn("run", _found("t", CANDIDATE, 0, 20, f"t rlike '[A-Za-z0-9+/_-]{{{WINDOW}}}'"))
    out = out.withColumn("windows", _entropy_spans("run"))
    tagged = [f"transform({k}, x -> named_struct('start', x.start, 'kind', {i}, 'end', x.end))" for i, k in enumerate(KINDS[:3])]
    out = out.withColumn("base", F.expr(f"sort_array(concat({', '.join(tagged)}))"))
    both = "sort_array(concat(base, transform(windows, x -> named_struct('start', x.start, 'kind', 3, 'end', x.end))))"
    reach = _running("transform(every, x -> if(x.kind < 3, x.end, 0L))", MAX)
    outside = f"transform(filter(zip_with(every, {reach}, (x, y) -> named_struct('x', x, 'y', y)), z -> z.x.kind < 3 or z.y < z.x.end), z -> z.x)"
    return out.withColumn("spans", F.expr(f"if(size(windows) = 0, base, {_let('every', both, outside)})"))


def _listed(spans: str) -> str:
    kinds = ", ".join(f"'{k}'" for k in KINDS)
    return f"array_join(transform({spans}, x -> concat(array({kinds})[x.kind], ':', x.start, ':', x.end)), ',')"


def scanned(docs: DataFrame) -> DataFrame:
    """One row for each document: the counts of the base kinds, a digest of the base spans, and all spans."""
    out = _with_spans(docs.selectExpr("cast(doc_id as long) doc_id", "coalesce(cast(text as string), '') t"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    added = F.expr("size(filter(spans, x -> x.kind = 3))").cast("long").alias("n_entropy")
    return out.select("doc_id", *counts, F.sha2(F.expr(_listed("base")), 256).alias("base_sha256"), F.expr(_listed("spans")).alias("spans"), added)


def _part(a: str, b: str) -> str:
    """SQL of the text from a to b, where ``blocks`` has it in blocks of TEXT_BLOCK characters."""
    n = TEXT_BLOCK
    first = f"substring(coalesce(get(blocks, cast({a} div {n} as int)), ''), cast({a} % {n} + 1 as int), cast({b} - {a} as int))"
    middle = f"array_join(slice(blocks, cast({a} div {n} + 2 as int), cast(greatest({b} div {n} - {a} div {n} - 1, 0L) as int)), '')"
    last = f"if({b} div {n} > {a} div {n}, substring(coalesce(get(blocks, cast({b} div {n} as int)), ''), 1, cast({b} % {n} as int)), '')"
    return f"concat({first}, {middle}, {last})"


def redacted(docs: DataFrame) -> DataFrame:
    """The documents with a mark in the place of each secret; n_chars follows where a text changed.

    Spans that overlap get one mark, spans that only touch one each.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    out = _with_spans(docs.select(row, F.expr("coalesce(cast(text as string), '')").alias("t")))
    reach = _running("transform(spans, x -> cast(x.end as bigint))", MAX)
    heads = "filter(spans, (x, i) -> i = 0 or x.start >= r[greatest(i - 1, 0)])"
    tails = "filter(r, (y, i) -> i = size(r) - 1 or spans[least(i + 1, size(r) - 1)].start >= y)"
    out = out.withColumn("cuts", F.expr(f"if(size(spans) = 0, null, {_let('r', reach, f'zip_with({heads}, {tails}, (x, y) -> named_struct({chr(39)}start{chr(39)}, x.start, {chr(39)}end{chr(39)}, y))')})"))
    out = out.withColumn("blocks", F.expr(f"if(cuts is null, null, regexp_extract_all(t, '(?s).{{1,{TEXT_BLOCK}}}', 0))"))
    before = _part("if(i = 0, 0L, cuts[greatest(i - 1, 0)].end)", "x.start")
    tail = _part("element_at(cuts, -1).end", "cast(length(t) as bigint)")
    out = out.withColumn("new", F.expr(f"if(cuts is null, cast(row.text as string), concat(array_join(transform(cuts, (x, i) -> concat({before}, '{MARK}')), ''), {tail}))"))
    columns = []
    for c in docs.columns:
        old = F.col("row").getField(c)
        if c == "text":
            columns.append(F.col("new").alias(c))
        elif c == "n_chars":
            columns.append(F.when(F.col("cuts").isNotNull(), F.length("new").cast(docs.schema[c].dataType)).otherwise(old).alias(c))
        else:
            columns.append(old.alias(c))
    return out.select(*columns)
