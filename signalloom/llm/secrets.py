"""Secrets in texts: fixed patterns, and entropy of sliding windows by character class.

The patterns of ``BASE`` find assignments of passwords and tokens, access keys and long hex strings.
Beyond them, each class of ``CLASSES`` takes the runs of its characters in a text as candidate
strings, of at least one window, that hold the kinds of characters which random strings of the class
hold. A window slides over a candidate a character at a time. The counts of the characters inside
are kept by taking the leaving one out and the entering one in, and with them the sum of n log2 n
over the counts, from which Shannon's entropy follows: log2(w) - sum / w. Windows of the class's
entropy or more are hot, and overlapping hot windows make one span.

An allow-list takes candidates out again: ``ALLOWED`` holds patterns of strings that are no secrets
(UUIDs, alphabets and digits in order, examples and placeholders), and callers may add strings of
their own. A span inside one of a pattern, or of an earlier class, is not told twice. Spans of the
patterns always stay.

Counts of up to 31 are packed twelve to a whole number, so that the state of a window is seven of
them; the terms n log2 n are whole millionths, so the sum does not depend on the order of steps. A
candidate is taken in blocks of ``BLOCK`` characters, each with the window's rest behind it, and
positions come from sums in two levels: no step copies what grows with the text. Only DataFrame
functions are used, there is no shuffle, and a text is looked at in its own task.

Nulls and edges: a null or empty text has no spans; positions count code points; ids, repeated rows
and other columns make no difference and pass through, except columns named like the results, which
are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalloom.llm.shared import table, text_or_empty

#: Patterns: kind, pattern, group whose length counts, least length. Fixed values.
BASE = (
    (
        "assign",
        r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    # The longest run decides about its length, so shorter ones need not be found first.
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)

#: Classes: kind, its characters, characters that a candidate has to hold, window, entropy in thousandths of a bit.
CLASSES = (
    ("entropy_hex", "A-Fa-f0-9", ("[0-9]", "[A-Fa-f]"), 24, 3000),
    ("entropy_alnum", "a-z0-9", ("[0-9]", "[a-z]"), 24, 3700),
    ("entropy_base64", "A-Za-z0-9+/", ("[0-9]", "[a-z]", "[A-Z]"), 24, 4000),
    ("entropy_urlsafe", "A-Za-z0-9_-", ("[0-9]", "[a-z]", "[A-Z]"), 24, 4000),
)

#: Candidates that hold a match of one of these are no secrets. Fixed values.
ALLOWED = (
    r"[Ee][Xx][Aa][Mm][Pp][Ll][Ee]",
    r"[Pp][Ll][Aa][Cc][Ee][Hh][Oo][Ll][Dd][Ee][Rr]",
    r"[Cc][Hh][Aa][Nn][Gg][Ee][_-]?[Mm][Ee]",
    r"0123456789|1234567890|abcdefghij|ABCDEFGHIJ",
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
)

#: Characters of a candidate taken at once; pieces whose lengths are summed at once.
BLOCK, RUN = 512, 256
#: Lowest code of a class's characters, codes packed in a whole number, and bits of a count.
_FIRST, _PACKED, _BITS = ord("+"), 12, 5
_SLOTS = (ord("z") - _FIRST) // _PACKED + 1
RESULTS = ("n_assign", "n_access", "n_hex", "base", "found")
_SPAN = "array<struct<start:int,rank:int,kind:string,end:int>>"


def _micro(count: int) -> int:
    """count * log2(count), in millionths."""
    return round(1_000_000 * count * math.log2(count)) if count else 0


def entropy_limit(window: int, entropy: int) -> int:
    """The greatest sum of n log2 n, in millionths, that a hot window may have."""
    return math.floor(1_000_000 * window * (math.log2(window) - entropy / 1000))


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _before(sizes: Column) -> Column:
    """The sum of the sizes before each place. Sums of runs, then sums within them."""
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(sizes) - 1, F.lit(0)), F.lit(RUN)), lambda a: F.slice(sizes, a + 1, RUN))

    def running(x: Column) -> Column:
        start = F.array(F.lit(0))
        return F.aggregate(x, start, lambda s, n: F.concat(s, F.array(F.element_at(s, -1) + n)))

    def placed(runs: Column) -> Column:
        totals = running(F.transform(runs, lambda r: F.aggregate(r, F.lit(0), lambda s, n: s + n)))
        return _let(totals, lambda t: F.flatten(F.transform(runs, lambda r, i: F.transform(F.slice(running(r), F.lit(1), F.size(r)), lambda x: x + F.get(t, i)))))

    return _let(runs, placed)


def _matches(text: Column, pattern: str) -> Column:
    """Matches of a pattern in order: ``start`` and ``value``."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(values: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        sizes = F.zip_with(F.slice(gaps, F.lit(1), F.size(values)), values, lambda g, v: F.struct(F.char_length(g).alias("gap"), F.char_length(v).alias("own")))

        def starts(sizes: Column) -> Column:
            earlier = _before(F.transform(sizes, lambda s: s["gap"] + s["own"]))
            return F.zip_with(F.zip_with(earlier, sizes, lambda e, s: e + s["gap"]), values, lambda a, v: F.struct(a.alias("start"), v.alias("value")))

        return F.when(F.size(values) > 0, _let(sizes, starts)).otherwise(F.array().cast("array<struct<start:int,value:string>>"))

    return _let(found, placed)


def _span(start: Column, rank: int, kind: str, end: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), end.cast("int").alias("end"))


def _base_spans(text: Column, rank: int) -> Column:
    kind, pattern, group, least = BASE[rank]
    counted = lambda v: F.char_length(F.regexp_extract(v, pattern, group)) if group else F.char_length(v)
    long = F.filter(_matches(text, pattern), lambda m: counted(m["value"]) >= least)
    return F.transform(long, lambda m: _span(m["start"], rank, kind, m["start"] + F.char_length(m["value"])))


def _merged(spans: Column) -> Column:
    """Spans in order of their start, with overlapping ones made one. ``spans`` have ``a`` and ``b``."""
    none = F.array().cast("array<struct<a:int,b:int>>")

    def step(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(last["a"].alias("a"), x["b"].alias("b"))))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["b"] >= x["a"]), joined).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(spans, none, step)


def hot_windows(block: Column, window: int, limit: int) -> Column:
    """Merged spans of the windows of a string whose sum of n log2 n is within ``limit``.

    One pass of events: a character leaves, which is none at first, and one enters. The state is the
    packed counts, the sum, and the spans so far.
    """
    terms = F.array(*(F.lit(_micro(n)) for n in range(window + 2)))
    codes = F.transform(F.split(block, ""), lambda c: F.ascii(c) - F.lit(_FIRST))

    def events(codes: Column) -> Column:
        event = lambda code, by, at: F.struct(code.alias("code"), F.lit(by).alias("by"), at.alias("at"))

        def both(i: Column) -> Column:
            leaving = F.when(i >= window, event(F.get(codes, i - window), -1, F.lit(-1)))
            return F.array(leaving, event(F.get(codes, i), 1, i))

        return F.flatten(F.transform(F.sequence(F.lit(0), F.char_length(block) - 1), both))

    no_spans = F.array().cast("array<struct<a:int,b:int>>")
    start = F.struct(F.array(*[F.lit(0).cast("long")] * _SLOTS).alias("counts"), F.lit(0).alias("sum"), no_spans.alias("spans"))

    def counted(state: Column, e: Column) -> Column:
        slot, shift = F.call_function("div", e["code"], F.lit(_PACKED)).cast("int"), (e["code"] % _PACKED) * _BITS
        n = F.call_function("shiftright", F.get(state["counts"], slot), shift).bitwiseAND(F.lit((1 << _BITS) - 1)).cast("int")
        moved = F.call_function("shiftleft", F.lit(1).cast("long"), shift) * e["by"]
        counts = F.transform(state["counts"], lambda x, i: F.when(i == slot, x + moved).otherwise(x))
        change = F.get(terms, n + e["by"]) - F.get(terms, n)
        total = state["sum"] + change
        a, b = e["at"] - (window - 1), e["at"] + 1
        here = F.struct(a.alias("a"), b.alias("b"))
        last = F.try_element_at(state["spans"], F.lit(-1))
        longer = F.concat(F.slice(state["spans"], F.lit(1), F.size(state["spans"]) - 1), F.array(F.struct(last["a"].alias("a"), b.alias("b"))))
        spans = F.when(F.coalesce(last["b"] >= a, F.lit(False)), longer).otherwise(F.concat(state["spans"], F.array(here)))
        hot = (a >= 0) & (e["at"] >= 0) & (total <= limit)
        return F.struct(counts.alias("counts"), total.alias("sum"), F.when(hot, spans).otherwise(state["spans"]).alias("spans"))

    moving = F.filter(_let(codes, events), lambda e: e.isNotNull())
    return F.aggregate(moving, start, counted, lambda s: s["spans"])


def _class_spans(text: Column, number: int, allowed: Sequence[str], allow: Sequence[str]) -> Column:
    kind, characters, held, window, entropy = CLASSES[number]
    limit = entropy_limit(window, entropy)

    def is_candidate(v: Column) -> Column:
        out = F.lit(True)
        for pattern in held:
            out = out & v.rlike(pattern)
        for pattern in allowed:
            out = out & ~v.rlike(pattern)
        return out & ~v.isin(list(allow)) if allow else out

    def spans(m: Column) -> Column:
        def of_blocks(blocks: Column) -> Column:
            whole = lambda b, i: F.concat(b, F.coalesce(F.left(F.get(blocks, i + 1), F.lit(window - 1)), F.lit("")))
            inside = lambda b, i: F.transform(hot_windows(whole(b, i), window, limit), lambda s: F.struct((s["a"] + i * BLOCK).alias("a"), (s["b"] + i * BLOCK).alias("b")))
            return _merged(F.flatten(F.transform(blocks, inside)))

        found = _let(F.regexp_extract_all(m["value"], F.lit(f".{{1,{BLOCK}}}"), F.lit(0)), of_blocks)
        return F.transform(found, lambda s: _span(m["start"] + s["a"], len(BASE) + number, kind, m["start"] + s["b"]))

    candidates = F.filter(_matches(text, f"[{characters}]{{{window},}}"), lambda m: is_candidate(m["value"]))
    return F.flatten(F.transform(candidates, spans))


def _told(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def with_secrets(docs: DataFrame, allowed: Sequence[str] = ALLOWED, allow: Sequence[str] = ()) -> DataFrame:
    """``docs`` with ``n_assign``, ``n_access``, ``n_hex``, and spans ``base`` and ``found`` as arrays.

    ``allowed`` are patterns, ``allow`` whole candidate strings that are no secrets. Spans are structs
    of ``start``, ``rank`` of the kind, ``kind`` and ``end``, which is exclusive, in order.
    """
    text = text_or_empty()
    n = len(BASE)
    rows = docs.select(*(c for c in docs.columns if c not in RESULTS), *(_base_spans(text, k).alias(f"__secrets_{k}") for k in range(n)))
    found = F.concat(*(F.col(f"__secrets_{k}") for k in range(n)))
    # A text without a long run of any class is not looked at class by class.
    some = text.rlike(f"[A-Za-z0-9+/_-]{{{min(c[3] for c in CLASSES)},}}")
    rows = rows.withColumn("base", F.array_sort(found)).withColumn("__secrets_told", F.col("base"))
    for number in range(len(CLASSES)):
        more = F.when(some, _class_spans(text, number, allowed, allow)).otherwise(F.array().cast(_SPAN))
        new = F.filter(more, lambda s: ~F.exists("__secrets_told", lambda t: (t["start"] <= s["start"]) & (s["end"] <= t["end"])))
        rows = rows.withColumn("__secrets_told", F.concat("__secrets_told", new))
    return rows.select(
        *(c for c in docs.columns if c not in RESULTS),
        *(F.size(f"__secrets_{k}").cast("long").alias(f"n_{BASE[k][0]}") for k in range(n)),
        "base",
        F.array_sort("__secrets_told").alias("found"),
    )


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(_told(F.col("base")), 256).alias("base_sha256"), _told(F.col("found")).alias("spans"))


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_matches(kind: str, rank: int, pattern: str, keep: str) -> str:
    return f"""
    SELECT doc, {rank} AS rank, '{kind}' AS kind, start, start + length(value) AS stop, value
    FROM (SELECT doc, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS start, hits[i] AS value
          FROM (SELECT doc, hits, gaps, unnest(generate_series(1, len(hits))) AS i
                FROM (SELECT doc, regexp_extract_all(text, {_sql_text(pattern)}) AS hits, string_split_regex(text, {_sql_text(pattern)}) AS gaps FROM docs)))
    WHERE {keep}"""


def _oracle() -> str:
    """Windows are counted one by one and spans are told apart by gaps between their starts."""
    base = " UNION ALL ".join(
        _sql_matches(kind, k, p, f"length(regexp_extract(value, {_sql_text(p)}, {group})) >= {least}") for k, (kind, p, group, least) in enumerate(BASE)
    )
    candidates = " UNION ALL ".join(
        f"SELECT *, {window} AS size, {entropy_limit(window, entropy)} AS most FROM ("
        + _sql_matches(
            kind, len(BASE) + k, f"[{chars}]{{{window},}}",
            " AND ".join([f"regexp_matches(value, '{h}')" for h in held] + [f"NOT regexp_matches(value, '{a}')" for a in ALLOWED]),
        )
        + ")"
        for k, (kind, chars, held, window, entropy) in enumerate(CLASSES)
    )
    return f"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS doc, doc_id, coalesce(text, '') AS text FROM documents),
base AS MATERIALIZED ({base}),
candidates AS MATERIALIZED ({candidates}),
windows AS (
    SELECT doc, rank, kind, start + i - 1 AS a, size, most, unnest(string_split(value[i:i + size - 1], '')) AS c
    FROM (SELECT *, unnest(generate_series(1, length(value) - size + 1)) AS i FROM candidates)
), hot AS (
    SELECT doc, rank, kind, a, any_value(size) AS size
    FROM (SELECT doc, rank, kind, a, size, most, c, count(*) AS n FROM windows GROUP BY ALL)
    GROUP BY doc, rank, kind, a HAVING sum(CAST(round(1000000 * n * log2(n)) AS BIGINT)) <= any_value(most)
), parts AS (
    SELECT *, sum(fresh) OVER (PARTITION BY doc, rank ORDER BY a) AS part
    FROM (SELECT *, CASE WHEN a - lag(a) OVER (PARTITION BY doc, rank ORDER BY a) <= size THEN 0 ELSE 1 END AS fresh FROM hot)
), spans AS (
    SELECT doc, rank, kind, min(a) AS start, max(a + size) AS stop FROM parts GROUP BY doc, rank, kind, part
), found AS (
    SELECT doc, rank, kind, start, stop FROM base
    UNION ALL
    SELECT doc, rank, kind, start, stop FROM spans s
    WHERE NOT EXISTS (SELECT 1 FROM (SELECT doc, rank, start, stop FROM base UNION ALL SELECT doc, rank, start, stop FROM spans) e
                      WHERE e.doc = s.doc AND e.rank < s.rank AND e.start <= s.start AND s.stop <= e.stop)
), told AS (
    SELECT doc, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans,
        string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank < {len(BASE)}) AS base,
        {", ".join(f"count(*) FILTER (rank = {k}) AS n_{kind}" for k, (kind, *_) in enumerate(BASE))}
    FROM found GROUP BY doc
)
SELECT doc_id, {", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind, *_ in BASE)},
    sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN told USING (doc)
"""


OP13_SQL = _oracle()
